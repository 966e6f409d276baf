from pyspark.sql import types as T

from gleanery.llm import chat

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("speaker", T.StringType()), T.StructField("body", T.StringType())])


def rotations(rows, part):
    out = {}
    rows = {(c, t or 0, r or "unknown", x or "") for c, t, r, x in rows if c is not None}
    for conv in {c for c, *_ in rows}:
        for speaker in {r for c, _, r, _ in rows if c == conv and r != "system"}:
            for p in {t // part for c, t, *_ in rows if c == conv}:
                text, spans = "", []
                for _, t, r, x in sorted(v for v in rows if v[0] == conv and v[1] // part == p):
                    text += "<|start|>" + ("assistant" if r == speaker else "system" if r == "system" else f"user name={r}") + "\n"
                    if r == speaker:
                        spans.append((len(text), len(text) + len(x) + len("<|end|>\n")))
                    text += x + "<|end|>\n"
                out[conv, speaker, p] = (text, spans)
    return out


def test_against_python(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi 😀"), (1, 2, "bob", "hé"), (1, 3, "cy", ""), (1, 3, "ann", None), (1, 9, "ann", "late"), (2, 0, "user", "x"), (2, 0, "user", "x"), (None, 0, "user", "lost"), (3, 0, "system", "only"), (4, None, None, "who"), (5, 300, "user", "z " * 5000)]
    df = spark.createDataFrame([(*r, "s", "b") for r in rows], TURNS)
    for part in (chat.TURNS_A_PART, 2):
        got = {(r.conv_id, r.speaker, r.part): r for r in chat.rotate(df, turns_a_part=part).collect()}
        want = rotations(rows, part)
        assert got.keys() == want.keys()
        for k, (text, spans) in want.items():
            assert got[k].text == text and [(s.start, s.end) for s in got[k].mask_spans] == spans
            assert got[k].mask_chars == sum(b - a for a, b in spans)


def test_empty_table(spark):
    assert chat.rotate(spark.createDataFrame([], TURNS)).count() == 0


def test_native(spark):
    df = spark.createDataFrame([(1, 0, "a", "b", "s", "b")], TURNS)
    plan = chat.rotate(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
