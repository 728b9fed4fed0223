import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clauselake.functions.text import running_starts
from clauselake.operators import segment as S

LINES = ["Pasal 1", "Article 2B", "(1) one", "(2) two", "(a) x", "(b) y", "1. n", "2. m", "1.1 d", "2.1.3 e", "", "", " ", "text", "é ß"]


def _rows(spark, text):
    df = spark.createDataFrame([(1, text)], "version_id int, text string")
    return [tuple(r)[1:] for r in S.segment(df).orderBy("ordinal").collect()]


def test_sub_items_replace_their_heading(spark):
    rows = _rows(spark, "pre\nPasal 1\nintro\n(1) a\n(2) b\nPasal 2\nbody")
    assert rows == [
        (1, "Pasal 1 > Ayat (1)", "(1) a", 18, 24),
        (2, "Pasal 1 > Ayat (2)", "(2) b", 24, 29),
        (3, "Pasal 2", "Pasal 2\nbody", 30, 42),
    ]


def test_one_marker_is_not_enough_below_headings(spark):
    assert _rows(spark, "1. only") == [(1, None, "1. only", 0, 7)]
    assert _rows(spark, "(1) a\n(2) b") == [(1, "(1)", "(1) a", 0, 6), (2, "(2)", "(2) b", 6, 11)]


def test_paragraph_offsets_are_those_of_the_stripped_text(spark):
    assert _rows(spark, "\n\n\n a \n\n\n\nb") == [(1, None, "a", 4, 5), (2, None, "b", 10, 11)]


def test_blank_text_has_no_clause_and_other_text_has_one(spark):
    texts = [(1, ""), (2, " \n\t "), (3, None), (4, "x")]
    df = spark.createDataFrame(texts, "version_id int, text string")
    assert [r.version_id for r in S.segment(df).collect()] == [4]


def _expected(text):
    """Spans by plain matching, for comparison on small texts."""

    def cut(pattern, body):
        starts = [m.start() for m in re.finditer(pattern, body, re.M)]
        return list(zip(starts, starts[1:] + [len(body)]))

    if not text.strip():
        return []
    head = cut(r"^(?:PASAL|Pasal|ARTICLE|Article)\s+\d+[A-Z]?\b", text)
    if head:
        out = []
        for s, e in head:
            section = text[s:e].strip()
            for pattern in (r"^\(\d+\)\s+", r"^\([a-z]\)\s+"):
                items = cut(pattern, section)
                if len(items) >= 2:
                    out += [(s + a, s + b) for a, b in items]
                    break
            else:
                out.append((s, e))
        return out
    for pattern in (r"^\d+\.\d+(?:\.\d+)*\s+", r"^\d+\.\s+", r"^\(\d+\)\s+"):
        items = cut(pattern, text)
        if len(items) >= 2:
            return items
    spans, at = [], 0
    for piece in re.split(r"(\n{2,})", text):
        if piece.strip():
            lead = len(piece) - len(piece.lstrip())
            spans.append((at + lead, at + lead + len(piece.strip())))
        at += len(piece)
    return spans


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(LINES), max_size=12), min_size=20, max_size=40))
def test_spans_equal_plain_matching(spark, docs):
    texts = ["\n".join(lines) for lines in docs]
    df = spark.createDataFrame(list(enumerate(texts)), "version_id int, text string")
    got = {}
    for r in S.segment(df).orderBy("version_id", "ordinal").collect():
        got.setdefault(r.version_id, []).append((r.char_start, r.char_end))
    assert got == {i: _expected(t) for i, t in enumerate(texts) if _expected(t)}


def test_running_starts(spark):
    for n in (0, 1, 2, 10, 1000):
        df = spark.range(1).select(F.array(*[F.lit(i) for i in range(n)]).cast("array<int>").alias("a"))
        got = df.select(running_starts(F.col("a")).alias("s")).first().s
        assert got == [sum(range(i)) for i in range(n)]


def test_reference_falls_back_to_the_ordinal(spark):
    df = spark.createDataFrame([(7, None), (8, ""), (9, "Pasal 5")], "ordinal int, heading_path string")
    assert [r.clause_ref for r in S.clause_ref(df).orderBy("ordinal").collect()] == [
        "Klausul 7",
        "Klausul 8",
        "Pasal 5",
    ]
