"""Clauses to risk domains, and domains to size-bounded review requests."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauselake import constants as K
from clauselake.functions.running import running_total
from clauselake.functions.text import let, running_starts
from clauselake.operators.redact_rows import redact_rows
from clauselake.session import stored
from clauselake.sources.lexicon import Domain


def _domains(lexicon: list[Domain]) -> Column:
    """The constant domain list, attached to a row by a generator instead of a join."""
    return F.array(
        *[F.struct(F.lit(d.key).alias("domain"), F.lit(d.always).alias("always")) for d in lexicon]
    )


def trie_pattern(words: list[str]) -> str:
    """A pattern that matches the longest of ``words`` at a place.

    The words' trie written as groups. Where a node has several children, the next
    character is first told to be in one half of them or the other, so a place costs the
    depth of the trie and not the number of words.
    """
    children: dict = {}
    for word in words:
        node = children
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def among(node: dict, letters: list[str]) -> str:
        if len(letters) == 1:
            return _escaped(letters[0]) + below(node[letters[0]])
        half = len(letters) // 2
        first = "".join(_escaped(c) for c in letters[:half])
        return f"(?:(?=[{first}]){among(node, letters[:half])}|{among(node, letters[half:])})"

    def below(node: dict) -> str:
        letters = sorted(c for c in node if c)
        if not letters:
            return ""
        inner = among(node, letters)
        return f"(?:{inner})?" if "" in node else inner

    return below(children)


def _escaped(c: str) -> str:
    return c if c.isalnum() else f"\\x{{{ord(c):x}}}"


def keyword_hits(text: Column, lexicon: list[Domain]) -> Column:
    """(domain, number of its keywords contained in the text) for domains with any hit.

    One pass over the lower-cased text finds the longest keyword at every place; the
    keywords that begin another one are looked up with it, and those inside it have places of
    their own. So all overlapping keywords count, and there is no search per keyword.
    """
    owners: dict[str, list[int]] = {}
    for i, d in enumerate(lexicon):
        for word in d.keywords:
            owners.setdefault(word.lower(), []).append(i)
    empty = owners.pop("", [])  # is in every text
    words = sorted(owners)
    begins = {w: [v for v in (w[:n] for n in range(1, len(w) + 1)) if v in owners] for w in words}

    def listed(values: dict[str, list], kind: T.DataType) -> Column:
        # one literal, folded when the query is planned
        return F.from_json(F.lit(json.dumps(values)), T.MapType(T.StringType(), T.ArrayType(kind)))

    def counts(found: Column) -> Column:
        met = F.array_distinct(found)
        nested = {w: v for w, v in begins.items() if len(v) > 1}
        if nested:
            more = F.flatten(
                F.transform(met, lambda w: F.coalesce(F.element_at(listed(nested, T.StringType()), w), F.array(w)))
            )
            met = F.array_distinct(more)
        of = F.flatten(F.transform(met, lambda w: F.element_at(listed(owners, T.IntegerType()), w)))

        def totals(hits: Column) -> Column:
            return F.array(
                *[
                    F.struct(
                        F.lit(d.key).alias("domain"),
                        (F.size(F.filter(hits, lambda h: h == i)) + empty.count(i)).cast("int").alias("keywords"),
                    )
                    for i, d in enumerate(lexicon)
                ]
            )

        return F.filter(let(of, totals), lambda x: x["keywords"] > 0)

    if not words:
        found = F.array().cast("array<string>")
    else:
        found = F.regexp_extract_all(
            F.lower(F.coalesce(text, F.lit(""))), F.lit(f"(?s)(?=({trie_pattern(words)}))"), F.lit(1)
        )
    none = F.array().cast("array<struct<domain:string,keywords:int>>")
    if empty or not words:
        return let(found, counts) if empty else none
    return let(found, lambda f: F.when(F.size(f) > 0, counts(f)).otherwise(none))


def match_domains(clauses: DataFrame, lexicon: list[Domain]) -> DataFrame:
    """``version_id, ordinal, domain, keywords``: which clause mentions which domain."""
    return clauses.select(
        "version_id", "ordinal", F.inline(keyword_hits(F.col("text"), lexicon))
    )


def domain_presence(clauses: DataFrame, lexicon: list[Domain]) -> DataFrame:
    """Version x domain matrix with the number of matching clauses, zeros included.

    One aggregate: every clause counts into eighteen sums, combined map-side, and
    the finished row is turned into eighteen rows.
    """
    hits = F.transform(keyword_hits(F.col("text"), lexicon), lambda x: x["domain"])
    per_clause = clauses.select("version_id", hits.alias("_hits"))
    sums = per_clause.groupBy("version_id").agg(
        *[F.count_if(F.array_contains("_hits", d.key)).alias(f"n{i}") for i, d in enumerate(lexicon)]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(d.key).alias("domain"),
                F.lit(d.always).alias("always"),
                F.col(f"n{i}").alias("clauses"),
                (F.col(f"n{i}") > 0).alias("present"),
            )
            for i, d in enumerate(lexicon)
        ]
    )
    return sums.select("version_id", F.inline(rows))


def domain_gaps(presence: DataFrame) -> DataFrame:
    """Domains a version does not mention; two of them are evaluated all the same."""
    return presence.filter(~F.col("present")).select("version_id", "domain", "always")


def _mentions(text: Column, lexicon: list[Domain]) -> Column:
    """Keys of the domains with any keyword in the text."""
    return F.transform(keyword_hits(text, lexicon), lambda x: x["domain"])


def route_clauses(clauses: DataFrame, lexicon: list[Domain]) -> DataFrame:
    """``version_id, ordinal, domain, matched``: a row per clause and domain it mentions.

    A domain that no clause of a version mentions has one row with a null ordinal, which
    stands for all clauses of the version. The texts are searched once; what the search
    finds is written, and both kinds of rows are read from there.
    """
    tags = stored(
        clauses.select("version_id", "ordinal", _mentions(F.col("text"), lexicon).alias("_d")),
        "tags",
    )
    matched = tags.select(
        "version_id", "ordinal", F.explode("_d").alias("domain"), F.lit(True).alias("matched")
    )
    seen = tags.groupBy("version_id").agg(
        *[F.bool_or(F.array_contains("_d", d.key)).alias(f"n{i}") for i, d in enumerate(lexicon)]
    )
    absent = F.array(*[F.when(~F.col(f"n{i}"), F.lit(d.key)) for i, d in enumerate(lexicon)])
    kind = clauses.schema["ordinal"].dataType
    whole = seen.select(
        "version_id",
        F.lit(None).cast(kind).alias("ordinal"),
        F.explode(F.filter(absent, lambda k: k.isNotNull())).alias("domain"),
        F.lit(False).alias("matched"),
    )
    return matched.unionByName(whole)


def clause_entry(ordinal: Column, heading: Column, text: Column) -> Column:
    path = F.when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit(" ("), heading, F.lit(")")))
    return F.concat(
        F.lit(f"[{K.CLAUSE_LABEL} "),
        ordinal.cast("string"),
        F.coalesce(path, F.lit("")),
        F.lit("]\n"),
        text,
    )


ALL = "*"  # scope of the packing that every unmentioned domain of a version shares
_CHUNK = 128  # neighbouring clauses of a version whose texts move as one row


def _scope_lines() -> Column:
    """(scope, its lines in order) of a chunk's ``_lines`` and ``_hits``, for all scopes."""

    def of_domain(lines: Column, hits: Column, domain: Column) -> Column:
        mine = F.filter(hits, lambda h: h["domain"] == domain)
        return F.flatten(
            F.transform(mine, lambda h: F.filter(lines, lambda x: x["ordinal"] == h["ordinal"]))
        )

    hits = F.coalesce("_hits", F.array().cast("array<struct<ordinal:bigint,domain:string>>"))
    whole = F.array(F.struct(F.lit(ALL).alias("scope"), F.col("_lines").alias("lines")))
    return let(
        hits,
        lambda h: F.concat(
            whole,
            F.transform(
                F.array_distinct(h["domain"]),
                lambda d: F.struct(d.alias("scope"), of_domain(F.col("_lines"), h, d).alias("lines")),
            ),
        ),
    )


def _scope_pieces(max_chars: int) -> Column:
    """(segment, its lines) of a chunk's ``lines`` of one scope that begin at ``_base``."""

    def segment(line: Column, start: Column) -> Column:
        first = F.floor(start / max_chars)
        last = F.floor((start + line["size"] - 1) / max_chars)
        return F.when(line["size"].isNotNull(), F.when(first == last, first * 2).otherwise(first * 2 + 1))

    def cut(segments: Column) -> Column:
        placed = F.zip_with(
            F.col("lines"), segments, lambda x, g: F.struct(x["ordinal"].alias("ordinal"), x["size"].alias("size"), g.alias("g"))
        )
        own = lambda rows, g: F.transform(
            F.filter(rows, lambda r: r["g"].eqNullSafe(g)),
            lambda r: F.struct(r["ordinal"].alias("ordinal"), r["size"].alias("size")),
        )
        return let(
            placed,
            lambda rows: F.transform(
                F.array_distinct(segments), lambda g: F.struct(g.alias("segment"), own(rows, g).alias("lines"))
            ),
        )

    sizes = F.transform("lines", lambda x: F.coalesce(x["size"], F.lit(0)))
    segments = F.zip_with(F.col("lines"), running_starts(sizes), lambda x, s: segment(x, F.col("_base") + s))
    return let(segments, cut)


def _placed(routed: DataFrame, entries: DataFrame, max_chars: int) -> DataFrame:
    """Which lines of a chunk go into which part: numbers alone, no text.

    A row per chunk, scope and part; ``domains`` is there in the first chunk of a part, and
    ``whole`` tells that it is the only one.
    """
    at = ["version_id", "_chunk"]
    line = F.struct(F.col("ordinal").cast("bigint").alias("ordinal"), F.length("entry").cast("bigint").alias("size"))
    sized = entries.groupBy(*at).agg(F.sort_array(F.collect_list(line)).alias("_lines"))
    hit = F.struct(F.col("ordinal").cast("bigint").alias("ordinal"), "domain")
    hits = (
        routed.filter("matched AND domain IS NOT NULL")
        .groupBy("version_id", _chunk())
        .agg(F.sort_array(F.collect_list(hit)).alias("_hits"))
    )
    spread = sized.join(hits, at, "left").select(*at, F.inline(_scope_lines()))
    # one subtotal per chunk and scope goes through the window
    before = Window.partitionBy("version_id", "scope").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    total = F.aggregate("lines", F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x["size"], F.lit(0)))
    based = spread.withColumn("_size", total).withColumn("_base", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    pieces = based.select(*at, "scope", F.inline(_scope_pieces(max_chars)))
    within = Window.partitionBy("version_id", "scope", "segment")
    numbered = pieces.withColumns(
        {
            "part_no": F.dense_rank().over(Window.partitionBy("version_id", "scope").orderBy("segment")),
            "_from": F.min("_chunk").over(within),
            "_to": F.max("_chunk").over(within),
        }
    )
    scopes = (
        routed.select(
            "version_id",
            "domain",
            F.when(F.col("matched"), F.col("domain")).otherwise(F.lit(ALL)).alias("scope"),
        )
        .groupBy("version_id", "scope")
        .agg(F.array_sort(F.collect_set("domain")).alias("domains"))
    )
    return numbered.join(scopes, ["version_id", "scope"]).select(
        *at,
        "scope",
        "part_no",
        F.when(F.col("_chunk") == F.col("_from"), F.col("domains")).alias("domains"),
        (F.col("_from") == F.col("_to")).alias("whole"),
        "lines",
    )


def _chunk() -> Column:
    return F.floor(F.col("ordinal") / _CHUNK).alias("_chunk")


def pack_context(
    routed: DataFrame,
    clauses: DataFrame,
    max_chars: int = K.MAX_CONTEXT_CHARS,
    shared: bool = False,
    beside: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Clause texts per version and domain, in parts of at most ``max_chars``.

    The clauses of a domain lie one after the other on a line cut every ``max_chars``
    characters. Those inside a segment are a part, and a clause that lies across a cut is
    a part of its own; only a clause longer than ``max_chars`` makes a longer part, which
    is marked ``oversized``. Nothing is left out. The clauses of a version are packed once
    for all domains that it does not mention. Parts are numbered by sizes alone.

    Texts move once, in chunks of neighbouring clauses, and a part is joined where its chunk
    is; only the pieces of a part that lies in several chunks move again. ``shared`` leaves a
    row per packed text, with the array ``domains`` in place of ``domain``. ``beside`` gets
    the parts' ``version_id, part_no`` and returns them with further columns, which come to
    the chunks and so to the texts; parts that it does not return are left out, as by a join.
    """
    at = ["version_id", "_chunk"]
    entries = clauses.filter("version_id IS NOT NULL AND ordinal IS NOT NULL").select(
        "version_id",
        _chunk(),
        "ordinal",
        clause_entry(F.col("ordinal"), F.col("heading_path"), F.col("text")).alias("entry"),
    )
    places = stored(_placed(routed, entries, max_chars), "places")
    text = F.struct(F.col("ordinal").cast("bigint").alias("ordinal"), "entry")
    rows = entries.groupBy(*at).agg(F.collect_list(text).alias("_texts")).join(
        places.groupBy(*at).agg(F.collect_list(F.struct("scope", "part_no", "domains", "whole", "lines")).alias("_places")),
        at,
    )
    given, more = [], []
    if beside is not None:
        spots = places.filter("domains IS NOT NULL").select("version_id", "part_no", "_chunk").distinct()
        brought = beside(spots.select("version_id", "part_no").distinct())
        more = [c for c in brought.columns if c not in ("version_id", "part_no")]
        brought = spots.join(brought, ["version_id", "part_no"])
        brought = brought.groupBy(*at).agg(F.collect_list(F.struct("part_no", *more)).alias("_beside"))
        rows = rows.join(brought, at, "left")
        mine = F.filter("_beside", lambda b: b["part_no"] == F.col("part_no"))
        given = [F.when(F.col("domains").isNotNull(), mine).alias("_given")]  # once a part, in its first chunk
    carried = ["_texts", *(["_beside"] if given else [])]

    def parts(wanted: Callable[[Column], Column]) -> DataFrame:
        found = rows.select("version_id", *carried, F.inline(F.filter("_places", wanted)))
        pairs = F.flatten(
            F.transform(
                "lines",
                lambda x: F.transform(
                    F.filter("_texts", lambda t: t["ordinal"] == x["ordinal"]),
                    lambda t: F.struct(t["ordinal"].alias("ordinal"), t["entry"].alias("entry"), x["size"].alias("size")),
                ),
            )
        )
        return found.select("version_id", "scope", "part_no", "domains", pairs.alias("_p"), *given)

    whole = parts(lambda p: p["whole"]).withColumn("_p", F.sort_array("_p"))
    split = (
        parts(lambda p: ~p["whole"])
        .groupBy("version_id", "scope", "part_no")
        .agg(
            F.max("domains").alias("domains"),
            F.sort_array(F.flatten(F.collect_list("_p"))).alias("_p"),
            *[F.flatten(F.collect_list("_given")).alias("_given") for _ in given],
        )
    )
    chars = F.aggregate("_p.size", F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x, F.lit(0)))
    packed = whole.unionByName(split).select(
        "version_id",
        "domains" if shared else F.explode("domains").alias("domain"),
        "part_no",
        F.array_join("_p.entry", "\n\n").alias("context"),
        F.size("_p").alias("entries"),
        F.when(F.exists("_p.size", lambda x: x.isNotNull()), chars > max_chars).alias("oversized"),
        *[F.col("_given") for _ in given],
    )
    if not given:
        return packed
    at_once = F.inline(F.transform("_given", lambda g: F.struct(*[g[c].alias(c) for c in more])))
    return packed.select(*[c for c in packed.columns if c != "_given"], at_once)


def summary_sample(clauses: DataFrame, max_chars: int = K.MAX_SUMMARY_CHARS) -> DataFrame:
    """The clauses in order as input of summaries, in parts of ``max_chars`` characters.

    Part 1 is the usual sample; the other parts are the rest of the text. Each clause
    gives every part its own piece of it, found from running lengths.
    """
    entry = F.concat(
        F.lit(f"[{K.CLAUSE_LABEL} "), F.col("ordinal").cast("string"), F.lit("] "), "text", F.lit("\n")
    )
    lines = clauses.select("version_id", "ordinal", entry.alias("_e"))
    sizes = lines.select("version_id", "ordinal", F.length("_e").alias("_size"))
    ends = running_total(sizes, ["version_id"], ["ordinal"], F.col("_size"), "_end")
    start = F.col("_end") - F.col("_size")
    touched = ends.select(
        "version_id",
        "ordinal",
        start.alias("_start"),
        F.explode(
            F.sequence(F.floor(start / max_chars), F.floor((F.col("_end") - 1) / max_chars))
        ).alias("_part"),
    )
    begin = F.col("_part") * max_chars - F.col("_start")  # where the part begins in the entry
    piece = F.substring(
        F.col("_e"),
        F.greatest(begin, F.lit(0)).cast("int") + 1,
        (F.lit(max_chars) + F.least(begin, F.lit(0))).cast("int"),
    )
    joined = (
        touched.join(lines, ["version_id", "ordinal"])
        .groupBy("version_id", "_part")
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", piece.alias("p")))).alias("_p"))
    )
    return joined.select(
        "version_id",
        (F.col("_part") + 1).cast("int").alias("part_no"),
        F.array_join(F.transform("_p", lambda p: p["p"]), "").alias("sample"),
    )


def pack_comments(
    comments: DataFrame, mapping: DataFrame | None = None, limit: int = K.MAX_COMMENTS
) -> DataFrame:
    """All comments of a version as redacted blocks of ``limit`` comments, numbered ``part_no``.

    ``mapping`` (``version_id, token, original``) is shared by author, body and anchor of all
    comments, which extend it in reading order, across parts. Comments are numbered by
    running totals and redacted as rows of their own; a block is its own group of at most
    ``limit`` of them.
    """
    parts = ["author", "body", "anchor"]
    texts = comments.select(
        "version_id",
        "ordinal",
        *[F.coalesce(c, F.lit("")).alias(n) for c, n in zip(("author", "body", "anchor_text"), parts, strict=True)],
    )
    numbered = stored(running_total(texts, ["version_id"], ["ordinal", *parts], F.lit(1), "_n"), "comments")
    places = F.array(*[F.struct((F.col("_n") * 3 + i).alias("place"), F.col(c).alias("text")) for i, c in enumerate(parts)])
    rows = numbered.select("version_id", F.inline(places)).filter("text <> ''")
    if mapping is None:
        kind = numbered.schema["version_id"].dataType.simpleString()
        mapping = comments.sparkSession.createDataFrame([], f"version_id {kind}, token string, original string")
    clean, _ = redact_rows(rows, mapping)
    of = lambda i: F.max(F.when(F.col("place") % 3 == i, F.col("text")))
    whole = numbered.select("version_id", F.col("_n")).unionByName(
        clean.select("version_id", F.floor(F.col("place") / 3).alias("_n"), "place", "text"), allowMissingColumns=True
    )
    lined = whole.groupBy("version_id", "_n").agg(*[of(i).alias(c) for i, c in enumerate(parts)])
    line = F.concat(
        F.lit("- ["),
        F.coalesce("author", F.lit(K.ANONYMOUS)),
        F.lit("]: "),
        F.coalesce("body", F.lit("")),
        F.coalesce(F.concat(F.lit(f' ({K.ANCHOR_LABEL}: "'), "anchor", F.lit('")')), F.lit("")),
    )
    blocks = lined.groupBy("version_id", (F.floor((F.col("_n") - 1) / limit) + 1).cast("int").alias("part_no")).agg(
        F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))).alias("_l")
    )
    return blocks.select(
        "version_id", "part_no", F.array_join("_l.line", "\n").alias("comments"), F.size("_l").alias("n_comments")
    )


def batch_changes(diffs: DataFrame, size: int = K.DIFF_BATCH) -> DataFrame:
    """Numbered changes in batches per version pair; ``seq`` is the change's place in the diff.

    Both sides of a change are whole: a batch is bounded by its number of changes. Each batch is its own group of at most ``size`` rows.
    """
    side = lambda label, c: F.when(
        F.coalesce(F.col(c), F.lit("")) != "",
        F.concat(F.lit(f"\n{label}\n"), F.col(c)),
    )
    kind = F.coalesce(
        *[F.when(F.col("change_kind") == k, v) for k, v in K.CHANGE_LABELS.items()],
        F.col("change_kind"),
    )
    place = ((F.col("seq") - 1) % size + 1).cast("int")
    entry = F.concat(
        F.lit("\n["),
        place.cast("string"),
        F.lit("] "),
        kind,
        F.coalesce(side(K.BEFORE_LABEL, "before_text"), F.lit("")),
        F.coalesce(side(K.AFTER_LABEL, "after_text"), F.lit("")),
    )
    rows = diffs.select(
        "pair_id",
        F.floor((F.col("seq") - 1) / size).cast("int").alias("batch_no"),
        F.struct(place.alias("place"), entry.alias("entry")).alias("_e"),
    )
    batches = rows.groupBy("pair_id", "batch_no").agg(
        F.array_sort(F.collect_list("_e")).alias("_b")
    )
    return batches.select(
        "pair_id",
        "batch_no",
        F.size("_b").alias("changes"),
        F.array_join(F.transform("_b", lambda e: e["entry"]), "\n").alias("batch_text"),
    )


def sections_beside(
    versions: DataFrame, summaries: DataFrame, comments: DataFrame
) -> Callable[[DataFrame], DataFrame]:
    """What joins ``summary`` and ``comments`` to parts of known versions, a row per summary."""
    at = ["version_id", "part_no"]

    def beside(spots: DataFrame) -> DataFrame:
        return (
            spots.join(versions.select("version_id").distinct(), "version_id", "left_semi")
            .join(summaries.select("version_id", "summary"), "version_id", "left")
            .join(comments.select(*at, "comments"), at, "left")
        )

    return beside


def build_requests(
    versions: DataFrame,
    lexicon: list[Domain],
    contexts: DataFrame,
    summaries: DataFrame,
    comments: DataFrame,
    sections: bool = False,
) -> DataFrame:
    """``version_id, domain, part_no, request``: as many requests as the parts ask for.

    Sections: summary (or an explicit statement that there is none), the part's clauses,
    the part's comments if any, task line. The first part is always there; it says so
    when there is no clause. The domain list is a constant array, so versions are
    multiplied by a generator. ``contexts`` are as ``pack_context`` gives them, a row per
    domain or ``shared``: a text meets the summary and comments of its version and part
    first, and is multiplied by its domains last. Contexts packed with ``sections_beside``
    have met them and do not move.

    ``sections`` leaves the sections that requests are joined from, ``version_id, part_no,
    text, times``: what several requests of a part share comes once, with their number.
    """
    labels = F.array(
        *[
            F.struct(
                F.lit(d.key).alias("domain"),
                F.lit(d.label).alias("name"),
                F.lit(K.NO_CLAUSE_ALWAYS if d.always else K.NO_MATCHING_CLAUSE).alias("nothing"),
            )
            for d in lexicon
        ]
    )
    at = ["version_id", "part_no"]
    beside = sections_beside(versions, summaries, comments)
    if "domains" not in contexts.columns:
        contexts = contexts.withColumn("domains", F.array("domain"))
    covered = (
        contexts.select(*at, F.explode("domains").alias("_d")).groupBy(*at).agg(F.collect_set("_d").alias("_covered"))
    )
    if "comments" not in contexts.columns:
        contexts = contexts.join(beside(covered.select(*at)), at)
    shown = contexts.select(
        *at,
        "summary",
        "comments",
        "context",
        F.filter(labels, lambda d: F.array_contains("domains", d["domain"])).alias("_labels"),
    )
    # domains without a clause in a part: in the first part, and where there are comments
    bare = F.filter(
        labels, lambda d: ~F.coalesce(F.array_contains("_covered", d["domain"]), F.lit(False))
    )
    spots = versions.select("version_id").distinct().withColumn("part_no", F.lit(1)).unionByName(comments.select(*at))
    rest = (
        beside(spots.distinct())
        .join(covered, at, "left")
        .select(*at, "summary", "comments", F.lit(None).cast("string").alias("context"), bare.alias("_labels"))
    )
    wide = shown.unionByName(rest)
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    summary = F.when(
        filled("summary"), F.concat(F.lit(K.SUMMARY_HEADER + "\n"), "summary")
    ).otherwise(F.lit(K.NO_SUMMARY))
    heading = lambda name: F.concat(F.lit(K.CLAUSES_HEADER + " '"), name, F.lit("':\n"))
    bubbles = F.when(filled("comments"), F.concat(F.lit(K.COMMENTS_HEADER + "\n"), "comments"))
    task = lambda name, domain: F.concat(
        F.lit(K.TASK_LINE + " "), name, F.lit(" (key: "), domain, F.lit(")")
    )
    body = lambda nothing: F.coalesce("context", F.when(F.col("part_no") == 1, nothing))
    if not sections:
        return wide.select(*at, "summary", "comments", "context", F.inline("_labels")).select(
            "version_id",
            "domain",
            "part_no",
            F.concat_ws(
                "\n\n", summary, F.concat(heading(F.col("name")), body(F.col("nothing"))), bubbles, task(F.col("name"), F.col("domain"))
            ).alias("request"),
        )
    section = lambda text, times: F.struct(text.alias("text"), times.alias("times"))
    # a context follows its heading on the next line, where no domain has a word in it
    own = F.transform(
        "_labels",
        lambda d: section(
            F.concat_ws(
                "\n\n",
                F.when(body(d["nothing"]).isNotNull(), F.concat(heading(d["name"]), F.when(F.col("context").isNull(), d["nothing"]).otherwise(""))),
                task(d["name"], d["domain"]),
            ),
            F.lit(1),
        ),
    )
    common = F.array(*[section(t, F.size("_labels")) for t in (summary, F.col("context"), bubbles)])
    return wide.select(*at, F.inline(F.concat(common, own))).filter("text IS NOT NULL AND times > 0")


def request_budget(requests: DataFrame) -> DataFrame:
    """Size of the outbound traffic per domain: requests, characters, requests beyond the first part."""
    size = F.length("request")
    return requests.groupBy("domain").agg(
        F.count("*").alias("requests"),
        F.sum(size).alias("chars"),
        F.max(size).alias("max_chars"),
        F.count_if(F.col("part_no") > 1).alias("further_parts"),
        (F.count("*") * K.MAX_ATTEMPTS).alias("max_calls"),
    )
