"""Operators for preparing training text and vectors. Nothing outside this subpackage imports it."""

from pyspark import cloudpickle

import gleanery.llm as _self

# Functions sent to executors travel whole, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(_self)
