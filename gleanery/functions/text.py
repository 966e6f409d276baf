"""Column functions on text, web addresses and vectors; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that comparison texts leave out.
STOP_WORDS = (
    "the a an and or but in on at to for of with by is are was were be been being have has had do does did will would could should may might must can this that these those"
).split()
# Query parameters that identify a page and stay in its address.
ID_PARAMETERS = ("id", "post_id", "article_id", "p", "postid")


def words(text: Column) -> Column:
    """Normalised words: lower case, no punctuation, no stop words."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", "")
    return F.filter(F.split(F.trim(F.regexp_replace(plain, r"[ \t\r\n\f\x0B]+", " ")), " "), lambda w: (w != "") & ~w.isin(STOP_WORDS))


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(text, r"[ \t\r\n\f\x0B]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity of two arrays; two empty ones are alike, one empty one is unlike any other."""
    common, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(common / F.greatest(union, F.lit(1)))


def first_line(text: Column) -> Column:
    return F.split_part(text, F.lit("\n"), F.lit(1))


def truncate_sentence(text: Column, limit: int) -> Column:
    """At most `limit` characters: up to the last full stop within them, or else cut with dots."""
    cut = F.substring(text, 1, limit)
    upto = F.regexp_extract(cut, r"(?s)^(.*[.!?])", 1)
    return F.when(F.length(text) <= limit, text).when(upto != "", upto).otherwise(F.concat(F.substring(text, 1, limit - 3), F.lit("...")))


def sentences(text: Column, low: int = 30, high: int = 300) -> Column:
    """Sentences of low to high characters."""
    return F.filter(F.transform(F.split(text, r"[.!?\n]"), lambda s: F.trim(s)), lambda s: (F.length(s) >= low) & (F.length(s) <= high))


def script_shares(text: Column) -> Column:
    """Shares of Latin and of other letters among letters and digits."""
    latin = F.regexp_count(text, F.lit(r"[A-Za-z]"))
    all_ = F.regexp_count(text, F.lit(r"[\p{L}\p{N}]"))
    return F.struct((latin / F.greatest(all_, F.lit(1))).alias("latin"), ((all_ - latin) / F.greatest(all_, F.lit(1))).alias("other"))


def url_host(url: Column) -> Column:
    """The host in lower case without a leading www.; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"://([^/?#]+)", 1)), r"^www\.", "")


def normalise_url(url: Column) -> Column:
    """Scheme and host in lower case; no fragment, no closing slash, of the parameters only those that identify a page."""
    bare = F.regexp_extract(url, r"^([^#]*)", 1)
    base, query = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"\?(.*)$", 1)
    head, path = F.lower(F.regexp_extract(base, r"^([^/]*//[^/]*)", 1)), F.regexp_replace(base, r"^[^/]*//[^/]*", "")
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: F.split_part(p, F.lit("="), F.lit(1)).isin(*ID_PARAMETERS)), "&")
    return F.concat(head, F.regexp_replace(path, r"/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def html_text(html: Column, limit: int = 2000) -> Column:
    """Text of a page: no scripts, styles or tags, single blanks, cut at the limit with dots."""
    plain = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>", " ")
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, r"<[^>]*>", " "), r"[ \t\r\n\f\x0B]+", " "))
    return F.when(F.length(plain) > limit, F.concat(F.substring(plain, 1, limit), F.lit("..."))).otherwise(plain)


def slug(text: Column, limit: int = 50) -> Column:
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s-]", ""), r"[\s-]+", "-"), 1, limit), r"^-+|-+$", "")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def fold(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The text after all rules (pattern, replacement), in their order."""
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


def tidy(text: Column) -> Column:
    """No blanks at line ends, at most one empty line in a row, nothing around."""
    return F.trim(fold(text, [(r"[ \t]+(\n|$)", "$1"), (r"\n{3,}", "\n\n")]))


def keywords(text: Column, first: list[str], n: int = 3) -> Column:
    """The first n different words of over two characters that are no stop words; those in `first` come before the others."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), 0), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS)))
    return F.slice(F.concat(F.filter(found, lambda w: w.isin(first)), F.filter(found, lambda w: ~w.isin(first))), 1, n)


def variables(text: Column) -> Column:
    """Names in double braces, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{\{\s*(\w+)\s*\}\}"), 1))


def file_id(text: Column) -> Column:
    """A name that is safe in file names: up to 20 letters, digits, - and _, and a hash of the whole."""
    return F.concat(F.substring(F.regexp_replace(text, r"[^A-Za-z0-9_-]", ""), 1, 20), F.lit("_"), F.substring(F.md5(text), 1, 8))
