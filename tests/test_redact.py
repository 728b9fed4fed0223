import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from clauselake.constants import PII_PATTERNS
from clauselake.operators import redact as R
from clauselake.operators import redact_rows as RR


def _redact(spark, text):
    df = spark.createDataFrame([(1, text)], "version_id int, text string")
    mapping = {r.token: r.original for r in R.assign_tokens(df).collect()}
    return R.redact(df).first().redacted_text, mapping


def test_phone_keeps_the_text_around_it(spark):
    for text, original in [
        ("Hubungi 081234567890 segera", "081234567890"),
        ("Tel 0812-3456-7890, terima kasih", "0812-3456-7890"),
        ("Tel 0812 3456 7890", "0812 3456 7890"),
        ("081234567890", "081234567890"),
    ]:
        redacted, mapping = _redact(spark, text)
        assert mapping == {"[PHONE_1]": original}
        assert redacted == text.replace(original, "[PHONE_1]")


def test_equal_originals_share_a_token(spark):
    redacted, mapping = _redact(spark, "a@x.org b@x.org a@x.org")
    assert redacted == "[EMAIL_1] [EMAIL_2] [EMAIL_1]"
    assert mapping == {"[EMAIL_1]": "a@x.org", "[EMAIL_2]": "b@x.org"}


def test_numbering_continues_an_existing_mapping(spark):
    texts = spark.createDataFrame([(1, "old@x.org new@x.org")], "version_id int, text string")
    known = spark.createDataFrame([(1, "[EMAIL_4]", "old@x.org")], "version_id int, token string, original string")
    row = R.redact_with_mapping(texts, known).first()
    assert row.redacted_text == "[EMAIL_4] [EMAIL_5]"
    assert {(m.tokens, m.originals) for m in row.mapping} == {("[EMAIL_4]", "old@x.org"), ("[EMAIL_5]", "new@x.org")}


def test_strict_phone_needs_more_than_two_digits(spark):
    df = spark.createDataFrame([(1, "on 01 May, call 0812 3456 789")], "version_id int, text string")
    assert R.redact(df).first().redacted_text == "on [PHONE_1] May, call [PHONE_2]"
    assert R.redact(df, strict_phone=True).first().redacted_text == "on 01 May, call [PHONE_1]"


def test_first_binding_of_a_token_stays(spark):
    schema = "version_id int, token string, original string"
    base = spark.createDataFrame([(1, "[NIK_1]", "a")], schema)
    new = spark.createDataFrame([(1, "[NIK_1]", "b"), (1, "[NIK_2]", "c")], schema)
    assert {tuple(r) for r in R.merge_mapping(base, new).collect()} == {(1, "[NIK_1]", "a"), (1, "[NIK_2]", "c")}


def test_residual_audit_counts_what_is_left(spark):
    df = spark.createDataFrame(
        [(1, "clean [EMAIL_1] [PHONE_620]"), (2, "left a@x.org and b@x.org")], "version_id int, text string"
    )
    assert [tuple(r) for r in R.residual_pii_audit(df).collect()] == [(2, "EMAIL", 2)]


def test_clauses_of_a_version_share_tokens(spark):
    rows = [(1, 1, "a@x.org b@x.org"), (1, 2, "c@x.org a@x.org"), (2, 1, "c@x.org")]
    clauses = spark.createDataFrame(rows, "version_id int, ordinal int, text string")
    known = spark.createDataFrame([(1, "[EMAIL_1]", "b@x.org")], "version_id int, token string, original string")
    texts, extended = RR.redact_clauses(clauses, known)
    got = {(r.version_id, r.ordinal): r.redacted_text for r in texts.collect()}
    assert got == {(1, 1): "[EMAIL_2] [EMAIL_1]", (1, 2): "[EMAIL_3] [EMAIL_2]", (2, 1): "[EMAIL_1]"}
    assert {tuple(r) for r in extended.collect()} == {
        (1, "[EMAIL_1]", "b@x.org"), (1, "[EMAIL_2]", "a@x.org"), (1, "[EMAIL_3]", "c@x.org"), (2, "[EMAIL_1]", "c@x.org"),
    }


def test_rows_equal_a_fold_over_the_version(spark):
    """Texts one after the other with a growing mapping; beyond index 620 the phone pattern
    matches inside tokens, and addresses hold tokens of earlier stages."""
    rng = random.Random(4)
    rows = []
    for version in (1, 2, 3):
        for place in rng.sample(range(1000), 40):
            rows.append((version, place, "".join(rng.choices(PARTS, k=rng.randint(0, 14)))))
    rows += [(4, i, f"m{i}@x.org {'Jl. Mawar ' * (i % 3)}m{i // 2}@x.org, 0812-{i:04}-{i:04}") for i in range(660)]
    rows += [(5, 0, None), (5, 1, "[NIK\ue0000] 3273012345678901 [NIK_1]")]
    old = [(1, "[EMAIL_7]", "a@x.org"), (1, "[PHONE_2]", "12 known"), (3, "[odd]", "1234567890")]
    texts = spark.createDataFrame(rows, "version_id int, place int, text string")
    mapping = spark.createDataFrame(old, "version_id int, token string, original string")
    got, extended = RR.redact_rows(texts, mapping)
    redacted = {(r.version_id, r.place): r.text for r in got.collect()}
    tokens = {v: {r.token: r.original for r in extended.collect() if r.version_id == v} for v in range(1, 6)}
    for version in range(1, 6):
        known = {o: t for v, t, o in old if v == version}
        count = {1: {"EMAIL": 7, "PHONE": 2}}.get(version, {})
        for _, place, text in sorted((r for r in rows if r[0] == version), key=lambda r: r[1]):
            want, _ = _sequential(text or "", known, count)
            assert redacted[version, place] == want
        assert tokens[version] == {t: o for o, t in known.items()}
    assert any("[EMAIL_[PHONE_" in t for t in redacted.values())


def test_one_version_spans_tasks(spark):
    """A version that holds all rows is no single row or task."""
    rows = [(1, i, f"m{i % 50}@x.org and more") for i in range(2000)]
    texts = spark.createDataFrame(rows, "version_id int, place int, text string").repartition(8)
    none = spark.createDataFrame([], "version_id int, token string, original string")
    got, extended = RR.redact_rows(texts, none)
    assert extended.count() == 50
    parts = got.groupBy(F.input_file_name()).count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 2000


def _sequential(text, known=None, count=None):
    """The cascade, one replacement after the other, for comparison on small texts."""
    known, count = ({} if known is None else known), ({} if count is None else count)
    for kind, pattern in PII_PATTERNS:

        def token(m, kind=kind):
            if m.group(0) not in known:
                count[kind] = count.get(kind, 0) + 1
                known[m.group(0)] = f"[{kind}_{count[kind]}]"
            return known[m.group(0)]

        text = re.sub(pattern, token, text)
    return text, {v: k for k, v in known.items()}


PARTS = ["3273012345678901", "01.234.567.8-901.234", "a@x.org", "0812-3456-789", "+62 812 345", "1234567890", "Jl. Mawar no 5", "RT 03", ", ", " ", "\n", ". ", "x", "12"]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), min_size=20, max_size=40))
def test_cascade_equals_sequential_replacement_and_round_trips(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "version_id int, text string")
    redacted = {r.version_id: r.redacted_text for r in R.redact(df).collect()}
    mapping = R.assign_tokens(df)
    tokens = {}
    for r in mapping.collect():
        tokens.setdefault(r.version_id, {})[r.token] = r.original
    for i, text in enumerate(texts):
        want, want_map = _sequential(text)
        assert redacted[i] == want
        assert tokens.get(i, {}) == want_map
    back = {r.version_id: r.text for r in R.expand(R.redact(df), mapping.drop("token_no")).collect()}
    assert back == dict(enumerate(texts))


def test_one_search_gives_what_two_gave(spark):
    """Matches and the text around them, from one search; the mark in a text, nulls and no match included."""
    from clauselake import constants as K
    from clauselake.functions.text import every_second, matches_in_turn

    texts = [
        None, "", "nothing", "a1@b.org", "x a1@b.org, a1@b.org", "\uf8fea1@b.org \uf8fe b2@c.org\uf8fe", "éa@b.org ٣a@b.org",
        "3201234567890123 32012345678901234 ٣32012345678901234", "+62811223344 0812-3456-77 x0812345678",
        "JL. Merdeka 5, jalan İ 9\nRT 5 ǰl. gg.x", "Kjl. a. Rw.7 b", "12.345.678.9-012.345$1\\",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for kind, plain in K.PII_PATTERNS:
        fast = R._java(dict(R.patterns())[kind])
        pieces = matches_in_turn(F.col("text"), fast)
        rows = df.select(
            every_second(pieces, 1).alias("m"),
            every_second(pieces, 0).alias("o"),
            F.regexp_extract_all("text", F.lit(R._java(plain)), F.lit(0)).alias("m2"),
            F.split("text", R._java(plain), -1).alias("o2"),
        ).collect()
        assert all((r.m, r.o) == (r.m2, r.o2) for r in rows), (kind, rows)
    plan = R.redact(df.withColumn("version_id", F.lit(1)))._jdf.queryExecution().analyzed().toString()
    assert "regexp_replace" in plan
