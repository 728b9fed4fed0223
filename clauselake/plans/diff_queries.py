"""Registered queries for version differences and redlines; edits are planted by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauselake.operators import diff as V
from clauselake.operators import redline as E
from clauselake.operators import route as D
from clauselake.plans import fixtures as X


# --- fixtures -----------------------------------------------------------------
def _line_arrays(spark, sf_dir):
    docs = X.documents(spark, sf_dir)
    rows = docs.select("doc_id", "lang", X.lines_of(F.col("text")).alias("_l"))
    return rows.filter(F.size("_l") > 0)


def versions_of_documents(spark, sf_dir):
    """Clauses of two versions per document; the second has planted changes."""
    rows = _line_arrays(spark, sf_dir)

    def edited(line, i):
        n = i + 1
        none = F.array().cast("array<string>")
        text = F.when(n % 5 == 2, F.concat(line, F.lit(" (rev)"))).otherwise(line)
        added = F.concat(
            F.lit("Tambahan "), F.col("doc_id").cast("string"), F.lit("-"), n.cast("string")
        )
        return F.concat(
            F.when(n % 7 == 3, none).otherwise(F.array(text)),
            F.when(n % 11 == 4, F.array(added)).otherwise(none),
        )

    new = F.flatten(F.transform("_l", edited))
    side = lambda shift, lines: F.struct(
        (F.col("doc_id") * 2 + shift).alias("version_id"), lines.alias("lines")
    )
    both = rows.select(F.inline(F.array(side(0, F.col("_l")), side(1, new))))
    flat = both.select("version_id", F.posexplode("lines").alias("_p", "text"))
    return flat.select(
        "version_id",
        (F.col("_p") + 1).alias("ordinal"),
        F.lit(None).cast("string").alias("heading_path"),
        "text",
    )


def pairs(spark, sf_dir):
    docs = X.read(spark, sf_dir, "documents")
    status = F.when(F.col("source") < "src2", "failed").when(F.col("lang") != "de", "ok")
    return docs.select(
        F.col("doc_id").alias("pair_id"),
        (F.col("doc_id") * 2).alias("from_version"),
        (F.col("doc_id") * 2 + 1).alias("to_version"),
        status.alias("tc_parse_status"),
        "lang",
    )


def runs(spark, sf_dir, unmarked=None):
    """Words of the lines as runs with revision marks, numbered through the document.

    Documents in the language ``unmarked`` have runs without marks.
    """
    rows = _line_arrays(spark, sf_dir)
    words = F.flatten(
        F.transform(
            "_l",
            lambda x, i: F.transform(
                F.split(x, " ", -1), lambda w, k: F.struct(i.alias("para"), k.alias("k"), w.alias("w"))
            ),
        )
    )
    flat = rows.select("doc_id", "lang", F.posexplode(words).alias("pos", "_w"))
    kind = F.when(F.col("_w.k") % 7 == 3, "ins").when(F.col("_w.k") % 5 == 2, "del")
    if unmarked:
        kind = F.when(F.col("lang") != unmarked, kind)
    author = F.when(F.col("_w.k") % 3 == 0, "ana").when(F.col("_w.k") % 3 == 1, "budi").otherwise("")
    return flat.select(
        "doc_id",
        F.col("_w.para").alias("para"),
        "pos",
        kind.alias("kind"),
        author.alias("author"),
        F.concat(F.col("_w.w"), F.lit(" ")).alias("text"),
    )


def ranges(spark, sf_dir):
    starts = runs(spark, sf_dir).filter("pos % 5 = 0").select("doc_id", "pos")
    number = (F.col("pos") / 5).cast("int").cast("string")
    odd = F.col("doc_id") % 5 == 1
    return starts.select(
        "doc_id",
        F.when(odd, F.concat(F.lit("c"), number)).otherwise(number).alias("comment_id"),
        F.col("pos").alias("start_pos"),
        F.when(F.col("pos") % 35 != 0, F.col("pos") + F.col("pos") % 13 * 9).alias("end_pos"),
    )


# Both versions by rule, then the matching in its own words: equal clauses at a constant
# distance are runs; of each region the longest run inside it matches (the first of several),
# and what lies on either side of it are the next regions.
_ITEMS = (
    X.LINES
    + """,
newer AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub) AS INTEGER) AS ordinal FROM (
  SELECT doc_id, pos, 0 AS sub, CASE WHEN pos % 5 = 2 THEN line || ' (rev)' ELSE line END AS line FROM lines WHERE pos % 7 <> 3
  UNION ALL SELECT doc_id, pos, 1, 'Tambahan ' || doc_id || '-' || pos FROM lines WHERE pos % 11 = 4)),
both_sides AS MATERIALIZED (SELECT * FROM (SELECT doc_id, 'old' AS side, pos AS ordinal, line FROM lines
  UNION ALL SELECT doc_id, 'new', ordinal, line FROM newer) WHERE doc_id IN (SELECT doc_id FROM newer)),
equal AS (SELECT o.doc_id, o.ordinal AS i, n.ordinal AS j FROM (SELECT * FROM both_sides WHERE side = 'old') o
  JOIN (SELECT * FROM both_sides WHERE side = 'new') n ON o.doc_id = n.doc_id AND o.line = n.line),
diagonal AS MATERIALIZED (SELECT doc_id, d, min(i) AS i1, max(i) AS i2 FROM (SELECT doc_id, j - i AS d, i,
  i - row_number() OVER (PARTITION BY doc_id, j - i ORDER BY i) AS g FROM equal) GROUP BY doc_id, d, g),
matched AS MATERIALIZED (WITH RECURSIVE found AS (
  SELECT doc_id, 1::BIGINT AS a1, max(ordinal) FILTER (WHERE side = 'old')::BIGINT AS a2, 1::BIGINT AS b1,
    max(ordinal) FILTER (WHERE side = 'new')::BIGINT AS b2, 1::BIGINT AS i, 1::BIGINT AS j, 0::BIGINT AS n FROM both_sides GROUP BY doc_id
  UNION ALL
  SELECT doc_id, a1, a2, b1, b2, -best.i, -best.j, best.n FROM (
    SELECT doc_id, a1, a2, b1, b2, max({'n': hi - lo + 1, 'i': -lo, 'j': -(lo + d)}) AS best FROM (
      SELECT s.*, r.d, greatest(r.i1, s.a1, s.b1 - r.d)::BIGINT AS lo, least(r.i2, s.a2, s.b2 - r.d)::BIGINT AS hi
      FROM (SELECT doc_id, CASE behind WHEN 0 THEN a1 ELSE i + n END AS a1, CASE behind WHEN 0 THEN i - 1 ELSE a2 END AS a2,
                   CASE behind WHEN 0 THEN b1 ELSE j + n END AS b1, CASE behind WHEN 0 THEN j - 1 ELSE b2 END AS b2
            FROM found, (SELECT unnest([0, 1]) AS behind)) s JOIN diagonal r ON r.doc_id = s.doc_id)
    WHERE lo <= hi GROUP BY doc_id, a1, a2, b1, b2))
  SELECT * FROM found WHERE n > 0),
anchors AS MATERIALIZED (SELECT doc_id, unnest(range(i, i + n)) AS o, unnest(range(j, j + n)) AS n FROM matched),
marked AS (SELECT b.*, a.o IS NOT NULL AS anchor FROM both_sides b LEFT JOIN anchors a
  ON a.doc_id = b.doc_id AND b.ordinal = CASE b.side WHEN 'old' THEN a.o ELSE a.n END),
gapped AS (SELECT *, count(*) FILTER (WHERE anchor) OVER (PARTITION BY doc_id, side ORDER BY ordinal) AS gap FROM marked),
spot AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, side, gap ORDER BY ordinal) AS r FROM gapped WHERE NOT anchor),
change AS MATERIALIZED (SELECT coalesce(o.doc_id, n.doc_id) AS pair_id, coalesce(o.gap, n.gap) AS gap, coalesce(o.r, n.r) AS place,
  o.ordinal AS old_ordinal, n.ordinal AS new_ordinal, o.line AS before_text, n.line AS after_text,
  CASE WHEN o.line IS NULL THEN 'added' WHEN n.line IS NULL THEN 'removed' ELSE 'modified' END AS change_kind
  FROM (SELECT * FROM spot WHERE side = 'old') o FULL JOIN (SELECT * FROM spot WHERE side = 'new') n
  ON o.doc_id = n.doc_id AND o.gap = n.gap AND o.r = n.r WHERE o.line IS DISTINCT FROM n.line),
diff AS MATERIALIZED (SELECT pair_id, CAST(gap AS INTEGER) AS block_no, CAST(place AS INTEGER) AS place,
  change_kind, 'Klausul ' || coalesce(new_ordinal, old_ordinal) AS clause_ref, before_text, after_text, old_ordinal, new_ordinal FROM change),
seq AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY block_no, place) AS INTEGER) AS seq FROM diff)"""
)

_RUNS = (
    X.LINES
    + """,
word AS (SELECT doc_id, pos - 1 AS para, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS k FROM (SELECT *, string_split(line, ' ') AS w FROM lines)),
runs AS MATERIALIZED (SELECT doc_id, CAST(para AS INTEGER) AS para, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para, k) - 1 AS INTEGER) AS pos,
  CASE WHEN k % 7 = 3 THEN 'ins' WHEN k % 5 = 2 THEN 'del' END AS kind, CASE k % 3 WHEN 0 THEN 'ana' WHEN 1 THEN 'budi' ELSE '' END AS author, w || ' ' AS text FROM word),
ranges AS MATERIALIZED (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'c' ELSE '' END || (pos // 5) AS comment_id, pos AS start_pos,
  CASE WHEN pos % 35 <> 0 THEN pos + pos % 13 * 9 END AS end_pos FROM runs WHERE pos % 5 = 0)"""
)

_BLANKS = X.BLANKS
_REVISIONS = f"""revision AS MATERIALIZED (SELECT * FROM (SELECT doc_id, para,
  trim(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE kind IS DISTINCT FROM 'ins'), ''), '{_BLANKS}') AS original_text,
  trim(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE kind IS DISTINCT FROM 'del'), ''), '{_BLANKS}') AS revised_text,
  coalesce(list_sort(list(DISTINCT author) FILTER (WHERE kind IS NOT NULL AND author <> '')), []) AS authors, count(kind) AS marks FROM runs GROUP BY doc_id, para)
  WHERE marks > 0 AND original_text <> revised_text),
revised AS MATERIALIZED (SELECT doc_id AS pair_id, para AS block_no, 1 AS place, CASE WHEN original_text <> '' AND revised_text <> '' THEN 'modified'
  WHEN revised_text <> '' THEN 'added' ELSE 'removed' END AS change_kind, 'Paragraf ' || (para + 1) AS clause_ref,
  nullif(original_text, '') AS before_text, nullif(revised_text, '') AS after_text FROM revision)"""


# --- queries --------------------------------------------------------------------
def line_versions(spark, sf_dir):
    """Order lines as numbered versions of an order; the numbers have gaps."""
    items = X.read(spark, sf_dir, "lineitem")
    return items.groupBy(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("version_no")
    ).agg(
        F.max(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("version_id"),
        F.when(F.max("l_linestatus") == "F", "failed").alias("tc_parse_status"),
        (F.count("*") - 1).alias("total_changes"),
        (F.max("l_returnflag") == "R").alias("done"),
    )


_VERSIONS = """versions AS MATERIALIZED (SELECT l_orderkey AS document_id, l_linenumber AS version_no, max(l_orderkey * 10 + l_linenumber) AS version_id,
  CASE WHEN max(l_linestatus) = 'F' THEN 'failed' END AS tc_parse_status, count(*) - 1 AS total_changes, max(l_returnflag) = 'R' AS done FROM lineitem GROUP BY ALL)"""


def _prior(spark, sf_dir):
    rows = V.prior_version(line_versions(spark, sf_dir))
    return rows.select("version_id", "prior_version_id")


def _align(spark, sf_dir):
    places = V.align_clauses(pairs(spark, sf_dir), versions_of_documents(spark, sf_dir))
    return places.drop("from_version", "to_version")


def _paired(spark, sf_dir):
    blocks = V.align_clauses(pairs(spark, sf_dir), versions_of_documents(spark, sf_dir))
    return V.pair_replaced(blocks).drop("from_version", "to_version")


def diffs(spark, sf_dir):
    return V.diff_rows(pairs(spark, sf_dir), versions_of_documents(spark, sf_dir))


def _whitespace(spark, sf_dir):
    """Every line against itself, its padded self or its edited self."""
    rows = X.line_rows(spark, sf_dir)
    after = (
        F.when(F.col("pos") % 3 == 0, F.concat(F.lit(" "), "line", F.lit("\n")))
        .when(F.col("pos") % 3 == 1, F.col("line"))
        .otherwise(F.concat("line", F.lit("!")))
    )
    changes = rows.select(
        "doc_id", "pos", F.lit("modified").alias("change_kind"),
        F.col("line").alias("before_text"), after.alias("after_text"),
    )
    return V.drop_whitespace_changes(changes).select("doc_id", "pos", "after_text")


def _revisions(spark, sf_dir):
    rows = V.revision_texts(runs(spark, sf_dir))
    return rows.withColumn("authors", F.concat_ws(",", "authors"))


def _revision_diff(spark, sf_dir):
    return V.revisions_to_diff(V.revision_texts(runs(spark, sf_dir)))


def _source(spark, sf_dir):
    marked = V.revisions_to_diff(V.revision_texts(runs(spark, sf_dir, unmarked="en")))
    return V.choose_diff_source(pairs(spark, sf_dir), marked, diffs(spark, sf_dir))


def _anchors(spark, sf_dir):
    return V.anchor_comments(ranges(spark, sf_dir), runs(spark, sf_dir)).select(
        "doc_id", "comment_id", "anchor_text"
    )


def _comment_order(spark, sf_dir):
    rows = ranges(spark, sf_dir)
    mixed = rows.withColumn(
        "comment_id",
        F.when((F.col("doc_id") % 3 == 0) & (F.col("start_pos") % 10 == 0), F.concat(F.lit("x"), "comment_id"))
        .otherwise(F.col("comment_id")),
    )
    return V.order_comments(mixed.select("doc_id", "comment_id"))


def classified(spark, sf_dir):
    place = (F.col("block_no") + F.col("place")) % 4
    return diffs(spark, sf_dir).withColumns(
        {
            "materiality": F.when(place == 1, "material").when(place >= 2, "immaterial"),
            "classification_status": F.when(place == 0, "failed").when(place == 3, "low_confidence").otherwise("ok"),
        }
    )


def _counts(spark, sf_dir):
    return V.diff_counts(classified(spark, sf_dir), ["pair_id"])


def _order(spark, sf_dir):
    return V.diff_order(classified(spark, sf_dir)).select(
        "pair_id", "block_no", "place", "clause_ref", "display_rank"
    )


def _bucket(spark, sf_dir):
    return V.display_bucket(classified(spark, sf_dir)).select(
        "pair_id", "block_no", "place", "bucket", "in_material_view"
    )


def _availability(spark, sf_dir):
    versions = line_versions(spark, sf_dir)
    known = V.prior_version(versions.drop("total_changes", "done"))
    rows = V.diff_availability(
        known, versions.select("version_id", "total_changes"), versions.filter("done")
    )
    return rows.select("version_id", "diff_state")


def _complete(spark, sf_dir):
    counts = _counts(spark, sf_dir).join(
        pairs(spark, sf_dir).select("pair_id", "tc_parse_status"), "pair_id"
    )
    return V.diff_review_complete(counts).select("pair_id", "review_complete")


def _churn(spark, sf_dir):
    return V.clause_churn(diffs(spark, sf_dir).withColumn("document_id", F.col("pair_id") % 10))


def _batches(spark, sf_dir):
    return D.batch_changes(V.number_changes(diffs(spark, sf_dir)))


def line_clauses(spark, sf_dir):
    return X.line_rows(spark, sf_dir).select(
        F.concat_ws(":", "doc_id", "pos").alias("clause_id"), F.col("line").alias("text"), "pos"
    )


def edits(spark, sf_dir):
    """Up to three edits per line: two words starred, one text that does not occur."""
    words = F.split("text", " ", -1)
    edit = lambda n, a, b: F.struct(
        F.lit(n).alias("edit_no"), a.alias("original_text"), b.alias("revised_text")
    )
    second, fourth = F.get(words, F.lit(1)), F.get(words, F.lit(3))
    listed = F.array(
        edit(1, second, F.concat(second, F.lit("*"))),
        edit(2, fourth, F.concat(fourth, F.lit("*"))),
        edit(3, F.lit("~none~"), F.lit("something")),
    )
    accepted = F.when(F.col("pos") % 3 == 0, True).when(F.col("pos") % 3 == 1, False)
    rows = line_clauses(spark, sf_dir).select("clause_id", accepted.alias("accepted"), F.inline(listed))
    return rows.filter("original_text <> ''")


def _redlines(spark, sf_dir):
    return E.apply_edits(line_clauses(spark, sf_dir), edits(spark, sf_dir))


def _apply(spark, sf_dir):
    return _redlines(spark, sf_dir).select("clause_id", "tracked", "comment_only")


def _accept(spark, sf_dir):
    return E.accept_all(_redlines(spark, sf_dir)).select("clause_id", "accepted_text")


def _reject(spark, sf_dir):
    return E.reject_all(_redlines(spark, sf_dir)).select("clause_id", "rejected_text")


def _segments(spark, sf_dir):
    return E.redline_segments(_redlines(spark, sf_dir))


def _by_clause(spark, sf_dir):
    some = edits(spark, sf_dir).withColumn(
        "clause_id", F.when(F.col("edit_no") < 3, F.col("clause_id"))
    )
    rows = E.edits_by_clause(some)
    return rows.select("clause_id", F.size("edits").alias("n_edits"), F.col("edits")[0]["original_text"].alias("first_text"))


QUERIES = {
    "prior_version": _prior,
    "align_clauses": _align,
    "pair_replaced": _paired,
    "drop_whitespace_changes": _whitespace,
    "diff_rows": diffs,
    "revision_texts": _revisions,
    "revisions_to_diff": _revision_diff,
    "choose_diff_source": _source,
    "anchor_comments": _anchors,
    "order_comments": _comment_order,
    "diff_counts": _counts,
    "diff_order": _order,
    "display_bucket": _bucket,
    "diff_availability": _availability,
    "diff_review_complete": _complete,
    "clause_churn": _churn,
    "batch_changes": _batches,
    "apply_edits": _apply,
    "accept_all": _accept,
    "reject_all": _reject,
    "redline_segments": _segments,
    "edits_by_clause": _by_clause,
}

_CLASS = """classified AS MATERIALIZED (SELECT *, CASE (block_no + place) % 4 WHEN 1 THEN 'material' WHEN 2 THEN 'immaterial' WHEN 3 THEN 'immaterial' END AS materiality,
  CASE (block_no + place) % 4 WHEN 0 THEN 'failed' WHEN 3 THEN 'low_confidence' ELSE 'ok' END AS status FROM diff)"""
_PAIRS = "pair AS (SELECT doc_id AS pair_id, lang, CASE WHEN source < 'src2' THEN 'failed' WHEN lang <> 'de' THEN 'ok' END AS tc FROM documents)"
_DIFF_COLUMNS = "pair_id, block_no, place, change_kind, clause_ref, before_text, after_text"
# position of the second word, then of the fourth in what is left behind it
_EDITED = (
    X.LINES
    + """,
w AS (SELECT doc_id || ':' || pos AS clause_id, line, coalesce(string_split(line, ' ')[2], '') AS a, coalesce(string_split(line, ' ')[4], '') AS b FROM lines),
p AS (SELECT *, CASE WHEN a <> '' THEN strpos(line, a) ELSE 0 END AS pa FROM w),
q AS (SELECT *, CASE WHEN pa > 0 THEN substr(line, 1, pa - 1) ELSE '' END AS pre, CASE WHEN pa > 0 THEN substr(line, pa + length(a)) ELSE line END AS rest FROM p),
r AS (SELECT *, CASE WHEN b <> '' THEN strpos(rest, b) ELSE 0 END AS pb FROM q),
edited AS MATERIALIZED (SELECT *, CASE WHEN pb > 0 THEN substr(rest, 1, pb - 1) ELSE '' END AS mid, CASE WHEN pb > 0 THEN substr(rest, pb + length(b)) ELSE rest END AS tail FROM r)"""
)
_SEGMENTS = """segment AS (SELECT clause_id, unnest([1, 2, 3, 4, 5, 6, 7]) AS o, unnest(['kept', 'deleted', 'inserted', 'kept', 'deleted', 'inserted', 'kept']) AS kind,
  unnest([NULL, 1, 1, NULL, 2, 2, NULL]) AS edit_no, unnest([pre, CASE WHEN pa > 0 THEN a ELSE '' END, CASE WHEN pa > 0 THEN a || '*' ELSE '' END,
  mid, CASE WHEN pb > 0 THEN b ELSE '' END, CASE WHEN pb > 0 THEN b || '*' ELSE '' END, tail]) AS text FROM edited)"""

ORACLES = {
    "prior_version": f"WITH {_VERSIONS} SELECT v.version_id, p.version_id AS prior_version_id FROM versions v LEFT JOIN versions p ON p.document_id = v.document_id AND p.version_no = v.version_no - 1",
    "align_clauses": f"WITH {_ITEMS} SELECT pair_id, block_no, place, old_ordinal, new_ordinal FROM diff",
    "pair_replaced": f"WITH {_ITEMS} SELECT pair_id, block_no, place, old_ordinal, new_ordinal, change_kind FROM diff",
    "drop_whitespace_changes": f"WITH {X.LINES} SELECT doc_id, pos, line || '!' AS after_text FROM lines WHERE pos % 3 = 2",
    "diff_rows": f"WITH {_ITEMS} SELECT {_DIFF_COLUMNS} FROM diff",
    "revision_texts": f"WITH {_RUNS}, {_REVISIONS} SELECT doc_id, para, original_text, revised_text, array_to_string(authors, ',') AS authors FROM revision",
    "revisions_to_diff": f"WITH {_RUNS}, {_REVISIONS} SELECT * FROM revised",
    "choose_diff_source": f"""WITH {_ITEMS}, {_RUNS.split(X.LINES + ',')[1]}, {_REVISIONS}, {_PAIRS},
marks AS (SELECT * FROM revised JOIN pair USING (pair_id) WHERE lang <> 'en'),
use AS (SELECT pair_id, tc IS DISTINCT FROM 'failed' AND pair_id IN (SELECT pair_id FROM marks) AS tracked FROM pair)
SELECT {_DIFF_COLUMNS}, 'tracked_changes' AS diff_source FROM marks JOIN use USING (pair_id) WHERE tracked
UNION ALL SELECT {_DIFF_COLUMNS}, 'text_diff' FROM diff JOIN use USING (pair_id) WHERE NOT tracked""",
    "anchor_comments": f"""WITH {_RUNS}, shown AS (SELECT doc_id, list(CASE WHEN kind IS DISTINCT FROM 'del' THEN text ELSE '' END ORDER BY pos) AS l FROM runs GROUP BY doc_id)
SELECT doc_id, comment_id, CASE WHEN end_pos >= start_pos THEN trim(array_to_string(l[start_pos + 1:end_pos + 1], ''), '{_BLANKS}') END AS anchor_text
  FROM ranges JOIN shown USING (doc_id)""",
    "order_comments": f"""WITH {_RUNS}, c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND start_pos % 10 = 0 THEN 'x' ELSE '' END || comment_id AS comment_id FROM ranges),
k AS (SELECT *, TRY_CAST(comment_id AS BIGINT) AS n FROM c), f AS (SELECT *, count(*) FILTER (WHERE n IS NULL) OVER (PARTITION BY doc_id) = 0 AS numeric FROM k)
SELECT doc_id, comment_id, CASE WHEN numeric THEN n END AS numeric_key, CASE WHEN NOT numeric THEN comment_id END AS text_key, coalesce(n, 0) AS ordinal FROM f""",
    "diff_counts": f"""WITH {_ITEMS}, {_CLASS} SELECT pair_id, count(*) AS total_changes, count(*) FILTER (WHERE materiality = 'material') AS material_count,
  count(*) FILTER (WHERE materiality = 'immaterial') AS immaterial_count, count(*) FILTER (WHERE status = 'failed') AS unclassified_count FROM classified GROUP BY pair_id""",
    "diff_order": f"WITH {_ITEMS}, {_CLASS} SELECT pair_id, block_no, place, clause_ref, CASE WHEN materiality = 'material' OR status = 'failed' THEN 1 ELSE 2 END AS display_rank FROM classified",
    "display_bucket": f"""WITH {_ITEMS}, {_CLASS} SELECT pair_id, block_no, place, CASE WHEN status = 'failed' THEN 'needs_review' ELSE coalesce(materiality, 'needs_review') END AS bucket,
  status = 'failed' OR materiality = 'material' AS in_material_view FROM classified""",
    "diff_availability": f"""WITH {_VERSIONS} SELECT v.version_id, CASE WHEN v.version_no = 1 THEN 'first_version' WHEN p.version_id IS NULL THEN 'prior_missing'
  WHEN v.total_changes > 0 THEN 'available' WHEN NOT v.done THEN 'not_computed' WHEN v.tc_parse_status = 'failed' THEN 'unreadable_revisions' ELSE 'unchanged' END AS diff_state
  FROM versions v LEFT JOIN versions p ON p.document_id = v.document_id AND p.version_no = v.version_no - 1""",
    "diff_review_complete": f"""WITH {_ITEMS}, {_CLASS}, {_PAIRS} SELECT pair_id, count(*) FILTER (WHERE status = 'failed') = 0 AND any_value(tc) IS DISTINCT FROM 'failed' AS review_complete
  FROM classified JOIN pair USING (pair_id) GROUP BY pair_id""",
    "clause_churn": f"WITH {_ITEMS} SELECT pair_id % 10 AS document_id, clause_ref, change_kind, count(*) AS changes FROM diff GROUP BY ALL",
    "batch_changes": f"""WITH {_ITEMS}, entry AS (SELECT pair_id, (seq - 1) // 5 AS batch_no, seq, chr(10) || '[' || ((seq - 1) % 5 + 1) || '] ' ||
  CASE change_kind WHEN 'added' THEN 'Klausul baru ditambahkan' WHEN 'removed' THEN 'Klausul dihapus' ELSE 'Klausul diubah' END ||
  CASE WHEN before_text <> '' THEN chr(10) || 'Teks sebelumnya:' || chr(10) || before_text ELSE '' END ||
  CASE WHEN after_text <> '' THEN chr(10) || 'Teks baru:' || chr(10) || after_text ELSE '' END AS entry FROM seq)
SELECT pair_id, CAST(batch_no AS INTEGER) AS batch_no, CAST(count(*) AS INTEGER) AS changes, string_agg(entry, chr(10) ORDER BY seq) AS batch_text FROM entry GROUP BY ALL""",
    "apply_edits": f"""WITH {_EDITED} SELECT clause_id, CAST((pa > 0)::INT + (pb > 0)::INT AS INTEGER) AS tracked,
  CAST((a <> '' AND pa = 0)::INT + (b <> '' AND pb = 0)::INT + 1 AS INTEGER) AS comment_only FROM edited""",
    "accept_all": f"""WITH {_EDITED} SELECT clause_id, pre || CASE WHEN pa > 0 THEN a || '*' ELSE '' END || mid || CASE WHEN pb > 0 THEN b || '*' ELSE '' END || tail AS accepted_text FROM edited""",
    "reject_all": f"WITH {X.LINES} SELECT doc_id || ':' || pos AS clause_id, line AS rejected_text FROM lines",
    "redline_segments": f"WITH {_EDITED}, {_SEGMENTS} SELECT clause_id, CAST(row_number() OVER (PARTITION BY clause_id ORDER BY o) AS INTEGER) AS segment_no, kind, edit_no, text FROM segment WHERE text <> ''",
    "edits_by_clause": f"""WITH {_EDITED} SELECT clause_id, CAST((a <> '')::INT + (b <> '')::INT AS INTEGER) AS n_edits, CASE WHEN a <> '' THEN a ELSE b END AS first_text
  FROM edited WHERE a <> '' OR b <> ''""",
}
