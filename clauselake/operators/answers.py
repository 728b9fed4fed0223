"""Validation of model answers: a failure stays a failure and never turns into a harmless value.

Input ``responses``: ``request_id, attempt, content, input_tokens, output_tokens,
model, error`` (``error`` is set when the call itself failed). Answers are parsed
once into a variant column; a key given twice in one object counts as unparsable
unless the session allows duplicate keys (then the last one wins).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake import constants as K
from clauselake.functions.text import let, strip
from clauselake.session import stored


def parse_strict(c: Column) -> Column:
    """The whole string as one JSON value, else null.

    Wrapped in an array with an end mark first: the parser alone would accept text after
    a value. The array must hold the value and the mark, and nothing else; a value that
    closes the array itself leaves the mark outside, and is none. The mark is the string's
    own digest, which the string cannot hold.
    """

    def marked(text: Column, mark: Column) -> Column:
        whole = F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]'))
        return let(
            F.try_parse_json(whole),
            lambda v: F.when(
                (F.size(F.try_variant_get(v, "$", "array<variant>")) == 2)
                & (F.try_variant_get(v, "$[1]", "string") == mark),
                F.variant_get(v, "$[0]", "variant"),
            ),
        )

    # the text and its digest are bound, so neither is computed twice
    return let(c, lambda text: let(F.md5(text), lambda mark: marked(text, mark)))


def _get(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "string")


def _items(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT<")


def answer_value(content: Column) -> Column:
    """Whole string, else a fenced block, else from the first to the last brace."""

    def first_parsable(clean: Column) -> Column:
        fenced = F.nullif(F.regexp_extract(clean, K.JSON_FENCE, 1), F.lit(""))
        braced = F.nullif(F.regexp_extract(clean, K.JSON_BRACES, 0), F.lit(""))
        return F.coalesce(parse_strict(clean), parse_strict(fenced), parse_strict(braced))

    return let(strip(content), first_parsable)


def extract_json(responses: DataFrame) -> DataFrame:
    """Adds ``answer`` (variant, null when nothing parses) and ``parse_status``.

    The value goes through a one-element generator. Filters on parsed fields then
    stay above it; pushed below a plain projection they would parse a second time.
    """
    value = F.array(answer_value(F.col("content")))
    parsed = responses.select("*", F.explode(value).alias("answer"))
    return parsed.withColumn("parse_status", _status(F.col("answer").isNotNull()))


def _status(ok: Column) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), "ok").otherwise("failed")


def parse_finding(answers: DataFrame) -> DataFrame:
    """Vocabulary check; anything outside is failed with null values, never coerced."""
    kind, severity = F.lower(_get(F.col("answer"), "finding_type")), F.lower(
        _get(F.col("answer"), "severity")
    )
    ok = F.coalesce(kind.isin(K.FINDING_TYPES) & severity.isin(K.SEVERITIES), F.lit(False))
    texts = {
        "summary": F.coalesce(_get(F.col("answer"), "summary"), F.lit("")),
        "rationale": F.coalesce(_get(F.col("answer"), "rationale"), F.lit("")),
        "negotiation_ask": F.nullif(_get(F.col("answer"), "negotiation_ask"), F.lit("")),
    }
    return answers.withColumns(
        {
            "finding_status": _status(ok),
            "finding_type": F.when(ok, kind),
            "severity": F.when(ok, severity),
            **{name: F.when(ok, value) for name, value in texts.items()},
        }
    )


def parse_edits(answers: DataFrame) -> DataFrame:
    """Edits that are objects with an original and a revised text, in answer order."""
    edit = F.struct(
        _get(F.col("_e"), "original_text").alias("original_text"),
        _get(F.col("_e"), "revised_text").alias("revised_text"),
        F.coalesce(_get(F.col("_e"), "comment"), F.lit("")).alias("comment"),
    )
    listed = answers.select(
        "request_id", F.posexplode(_items(F.col("answer"), "$.suggested_edits")).alias("_pos", "_e")
    )
    kept = listed.filter(
        _is_object(F.col("_e")) & (_get(F.col("_e"), "original_text") != "")
        & (_get(F.col("_e"), "revised_text") != "")
    )
    return kept.select("request_id", (F.col("_pos") + 1).alias("edit_no"), edit.alias("_s")).select(
        "request_id", "edit_no", "_s.*"
    )


def citation_basis(answers: DataFrame) -> DataFrame:
    basis = _get(F.col("answer"), "citation_basis")
    return answers.withColumn("citation_basis", F.when(basis.isin(K.CITATION_BASES), basis))


def resolve_clause(answers: DataFrame, clauses: DataFrame) -> DataFrame:
    """The first listed ordinal that exists in the version; null when none does.

    ``answers``: ``request_id, version_id, answer``; ``clauses``: ``version_id,
    ordinal, clause_id``. Each answer goes on as a row of its own and one for every ordinal
    that it lists, so it is parsed once; the first clause found is then told to all answers
    of the request.
    """

    def listed(raw: Column, place: Column) -> Column:
        ordinal = F.when(raw.rlike(r"^\d+$"), raw.try_cast("int"))
        return F.struct(place.alias("pos"), ordinal.alias("ordinal"))

    raw = F.transform(
        _items(F.col("answer"), "$.clause_ordinals"), lambda v: F.try_variant_get(v, "$", "string")
    )
    found = F.filter(F.transform(raw, listed), lambda o: o["ordinal"].isNotNull())
    itself = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("int").alias("ordinal")))
    rows = answers.select(
        "*",
        # an answer without a request has no other answers to share with
        F.when(F.col("request_id").isNull(), F.monotonically_increasing_id()).alias("_alone"),
        F.explode(F.concat(itself, F.coalesce(found, F.array().cast("array<struct<pos:int,ordinal:int>>")))).alias("_o"),
    )
    known = clauses.select(
        F.col("version_id").alias("_version"), F.col("ordinal").alias("_ordinal"), F.col("clause_id").alias("_clause")
    )
    same = (F.col("version_id") == F.col("_version")) & (F.col("_o.ordinal") == F.col("_ordinal"))
    met = rows.join(known, same, "left").filter((F.col("_o.pos") < 0) | F.col("_ordinal").isNotNull())
    first = F.min_by("_clause", F.when(F.col("_ordinal").isNotNull(), F.col("_o.pos"))).over(
        Window.partitionBy("request_id", "_alone")
    )
    return (
        met.withColumn("_first", F.when(F.col("request_id").isNotNull(), first))
        .filter(F.col("_o.pos") < 0)
        .select("request_id", *[c for c in answers.columns if c != "request_id"], F.col("_first").alias("clause_id"))
    )


def _sized(df: DataFrame, usual: dict[str, int], cut: bool) -> DataFrame:
    """``oversized`` marks rows with a text beyond its usual length; ``cut`` shortens them."""
    over = F.lit(False)
    for name, size in usual.items():
        over = over | F.coalesce(F.length(name) > size, F.lit(False))
    marked = df.withColumn("oversized", over)
    if not cut:
        return marked
    return marked.withColumns({c: F.substring(c, 1, n) for c, n in usual.items()})


def persist_findings(findings: DataFrame, cut: bool = False) -> DataFrame:
    """Valid findings; type ``none`` leaves no row. Texts stay whole unless ``cut`` is asked for."""
    kept = findings.filter((F.col("finding_status") == "ok") & (F.col("finding_type") != "none"))
    return _sized(kept, K.FINDING_LENGTHS, cut)


def persist_edits(edits: DataFrame, findings: DataFrame, cut: bool = False) -> DataFrame:
    """Edits of stored findings; texts stay whole unless ``cut`` is asked for."""
    kept = edits.join(persist_findings(findings).select("request_id"), "request_id", "left_semi")
    return _sized(kept, K.EDIT_LENGTHS, cut)


def parse_materiality(batches: DataFrame) -> DataFrame:
    """One row per expected change of a batch: ``batch_id, place, materiality, status, reason``.

    Answers count by position; the index the model repeats is ignored. Surplus
    answers are cut, missing ones and values outside the vocabulary are failed, an
    unparsable answer (or one with entries that are no objects) fails the batch.
    Input: ``batch_id, content, expected``.
    """
    parsed = batches.select("*", F.explode(F.array(answer_value(F.col("content")))).alias("_v"))
    wrapped = F.coalesce(
        *[
            F.when(F.size(_items(F.col("_v"), f"$.{key}")) > 0, _items(F.col("_v"), f"$.{key}"))
            for key in ("changes", "items", "results")
        ],
        F.array().cast("array<variant>"),
    )
    listed = parsed.withColumn(
        "_items",
        F.when(_is_object(F.col("_v")), wrapped).otherwise(_items(F.col("_v"))),
    )
    usable = F.coalesce(F.forall("_items", _is_object), F.lit(False))

    def verdict(place: Column) -> Column:
        item = F.get(F.col("_items"), place)
        raw = F.coalesce(_get(item, "materiality"), F.lit(""))
        value = F.lower(raw)
        reason = F.coalesce(
            F.nullif(_get(item, "materiality_reason"), F.lit("")),
            F.nullif(_get(item, "reason"), F.lit("")),
            F.lit(K.NO_REASON),
        )
        ok = F.col("_usable") & value.isin(K.MATERIALITIES)
        return F.struct(
            (place + 1).alias("place"),
            F.when(ok, value).alias("materiality"),
            F.when(ok, "ok").otherwise("failed").alias("status"),
            F.when(~F.col("_usable"), K.UNPARSABLE_BATCH)
            .when(item.isNull(), K.MISSING_ANSWER)
            .when(ok, reason)
            .when(value == "", K.MISSING_CLASS)
            .otherwise(F.concat(F.lit(K.OUT_OF_VOCABULARY + ": '"), value, F.lit("'")))
            .alias("reason"),
        )

    ready = listed.filter("expected > 0").withColumn("_usable", usable)
    places = F.sequence(F.lit(0), F.col("expected") - 1)
    return ready.select("batch_id", F.inline(F.transform(places, verdict)))


def _attempt_state(responses: DataFrame) -> DataFrame:
    """Each round-trip as ``ok``, ``parse`` (billed, unusable) or ``call`` (never returned)."""
    usable = F.col("finding_status") == "ok"
    checked = parse_finding(extract_json(responses))
    return checked.withColumn(
        "state", F.when(F.col("error").isNotNull(), "call").when(usable, "ok").otherwise("parse")
    )


def _first_state() -> Column:
    return F.max(F.when(F.col("attempt") == 1, F.col("state")))


def _performed(responses: DataFrame) -> DataFrame:
    """All round-trips; ``expected`` tells those that the retry rule allows: the first, and
    the second after a parse failure.

    The first state of a request is a maximum that combines before the shuffle; only
    small columns move, contents and parsed answers stay behind. They are written, so answers
    are parsed once. Both sides of the join have a row per request at least, so neither is
    sent to every executor by way of the driver.
    """
    small = _attempt_state(responses).select(
        "request_id", "attempt", "domain", "state", "input_tokens", "output_tokens", "model"
    )
    small = stored(small, "attempts")
    first = small.groupBy("request_id").agg(_first_state().alias("_first"))
    second = (F.col("attempt") == 2) & (F.col("_first") == "parse")
    return small.join(first.hint("merge"), "request_id").withColumn(
        "expected", F.coalesce((F.col("attempt") == 1) | second, F.lit(False))
    )


def resolve_attempts(responses: DataFrame) -> DataFrame:
    """Outcome per request: a call error fails at once, a parse error retries once.

    One aggregate over the states; answers are parsed once. ``surplus`` counts round-trips
    that the rule does not ask for; they change nothing, and are metered all the same.
    """
    states = _attempt_state(responses)
    second = F.max(F.when(F.col("attempt") == 2, F.col("state")))
    both = states.groupBy("request_id").agg(
        _first_state().alias("_first"), second.alias("_second"), F.count(F.lit(1)).alias("_rows")
    )
    retried = (F.col("_first") == "parse") & F.col("_second").isNotNull()
    last = F.when(retried, F.col("_second")).otherwise(F.col("_first"))
    attempts = F.when(retried, 2).otherwise(1)
    return both.filter("_first is not null").select(
        "request_id",
        attempts.alias("attempts"),
        F.when(last == "ok", attempts).alias("winner"),
        F.when(last == "ok", "ok").otherwise("failed").alias("status"),
        F.when(last != "ok", last).alias("failure"),
        (F.col("_rows") - attempts).alias("surplus"),
    )


def meter_attempts(responses: DataFrame) -> DataFrame:
    """One usage row per round-trip. Failed calls have no tokens; billed failures keep theirs.

    Round-trips beyond the retry rule were billed too: their status is ``surplus``.
    """
    stage = F.when(F.col("state") == "call", F.concat(F.lit("llm_call:"), "domain")).when(
        F.col("state") == "parse", F.concat(F.lit("json_parse:"), "domain")
    )
    billed = F.col("state") != "call"
    return _performed(responses).select(
        "request_id",
        "attempt",
        F.when(billed, F.col("input_tokens")).alias("input_tokens"),
        F.when(billed, F.col("output_tokens")).alias("output_tokens"),
        F.when(billed, F.col("model")).alias("model"),
        F.when(~F.col("expected"), "surplus")
        .when(F.col("state") == "ok", "ok")
        .otherwise("failed")
        .alias("status"),
        stage.alias("failure_stage"),
    )


def meter_batches(batches: DataFrame) -> DataFrame:
    """Usage rows of change batches: only a failed call counts as failed."""
    failed = F.col("error").isNotNull()
    return batches.select(
        "batch_id",
        F.when(~failed, F.col("input_tokens")).alias("input_tokens"),
        F.when(~failed, F.col("output_tokens")).alias("output_tokens"),
        F.when(~failed, F.col("model")).alias("model"),
        F.when(failed, "failed").otherwise("ok").alias("status"),
        F.when(failed, "materiality_llm").alias("failure_stage"),
    )


def _usage_sums() -> list[Column]:
    return [
        F.count("*").alias("calls"),
        F.count_if(F.col("status") == "ok").alias("ok_calls"),
        F.count_if(F.col("status") == "failed").alias("failed_calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.count_if(F.col("input_tokens").isNull()).alias("unmetered_calls"),
    ]


def usage_rollup(usage: DataFrame) -> DataFrame:
    """Tokens and calls per user, day and model; calls without tokens are counted, not summed."""
    return usage.groupBy("user_id", F.to_date("created_at").alias("day"), "model").agg(*_usage_sums())


def usage_subtotals(usage: DataFrame) -> DataFrame:
    """``usage_rollup`` with its subtotals per user and day, per user, and in all.

    One scan; ``level`` says what a row sums up (``model``, ``day``, ``user`` or ``total``),
    so that a call without a model or user is told from a subtotal. The finest level is
    summed first, and the others from it: only sums of sums pass through the second shuffle.
    """
    fine = usage_rollup(usage)
    level = F.element_at(
        F.array(*[F.lit(x) for x in ("model", "day", "user", "total")]),
        F.bit_count(F.grouping_id()).cast("int") + 1,
    )
    sums = ["calls", "ok_calls", "failed_calls", "input_tokens", "output_tokens", "unmetered_calls"]
    return (
        fine.rollup("user_id", "day", "model")
        .agg(level.alias("level"), *[F.sum(c).alias(c) for c in sums])
        .select("level", "user_id", "day", "model", *sums)
    )


def summary_outcome(summaries: DataFrame) -> DataFrame:
    """``version_id, summary, summary_status`` from ``version_id, n_clauses, content, error``.

    A version without clauses has a fixed text; a failed call or an answer that is
    no object is failed with a null text. An object with neither key is kept as JSON.
    """
    v = answer_value(F.col("content"))
    text = F.coalesce(
        F.nullif(_get(F.col("_v"), "ringkasan"), F.lit("")),
        F.nullif(_get(F.col("_v"), "summary"), F.lit("")),
        F.to_json(F.col("_v")),
    )
    ok = F.coalesce(F.col("error").isNull() & _is_object(F.col("_v")), F.lit(False))
    empty = F.col("n_clauses") == 0
    return summaries.withColumn("_v", v).select(
        "version_id",
        F.when(empty, K.NO_CLAUSES_SUMMARY).when(ok, text).alias("summary"),
        F.when(empty | ok, "ok").otherwise("failed").alias("summary_status"),
    )
