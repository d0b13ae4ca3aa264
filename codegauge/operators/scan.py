"""Rule scanning: whole-text hits and first-rule-per-line findings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from codegauge.functions import matching as M, score as S, text as T
from codegauge.functions.literals import LineIndex
from codegauge.functions.rulebook import RULES, Rule
from codegauge.operators.batches import stretches

# Bytes of a rule table that travel to the executors at a time.
RULE_BLOCK_BYTES = 8 << 20
# Bytes of text that a task looks at together.
SCAN_BYTES = 1 << 18
OWNED = "array<struct<line_no:int,ord:int,rule_id:string,severity:int,message:string,line:string>>"


def with_hits(df: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    return df.withColumn("hits", M.rule_hits(rules=rules))


def with_owned_lines(df: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Adds `hits` (whole text) and `owned` (array of lines with their rule)."""
    scanned = with_hits(df, rules).withColumn("candidates", M.line_candidates(rules=rules))
    return scanned.withColumn("owned", M.owned_lines(rules=rules)).drop("candidates")


def explode_lines(df: DataFrame) -> DataFrame:
    """One row per line, numbered from 1."""
    keep = [c for c in df.columns if c != "code"]
    return df.select(*keep, F.posexplode(T.split_lines(F.col("code"))).alias("_pos", "line")).select(
        *keep, (F.col("_pos") + 1).alias("line_no"), "line")


def line_findings(df: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, lang, line_no, ord, rule_id, severity, line): a line belongs to its first rule."""
    # Outer generators throughout: an inner one makes the optimizer push "array not empty" below
    # the projections, which would evaluate the scan a second time.
    base = df.select("doc_id", "lang", "code")
    rows = with_owned_lines(base, rules).select("doc_id", "lang", F.inline_outer("owned")).filter("line_no is not null")
    return rows.select(
        "doc_id", "lang", "line_no", "ord", M.pick("rule_id", rules=rules).alias("rule_id"),
        M.pick("severity", rules=rules).alias("severity"), M.pick("message", rules=rules).alias("message"),
        "line")


def line_findings_from_table(df: DataFrame, rules: DataFrame, block_bytes: int = RULE_BLOCK_BYTES) -> DataFrame:
    """The same for rules held in a table (rule_id, lang, ord, pattern, severity, message), whatever their number.

    Row-local: the rules travel to the documents as an index over the literals they need, in blocks of bounded
    size (one, unless a pack passes `block_bytes`), and each block lowers the owner of the lines it hits. Of
    rules with one position the smaller rule_id owns the line. A null text or language has no findings.
    """
    state = df.select("doc_id", "lang", "code", F.lit(None).cast(OWNED).alias("owned"))
    schema = state.schema
    for block in _rule_blocks(rules, block_bytes):
        packs = df.sparkSession.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], packs=packs) -> Iterator[pa.RecordBatch]:
            indexes = {lang: (LineIndex([r[2] for r in pack]), pack) for lang, pack in packs.value.items()}
            for batch in batches:
                sizes = pc.binary_length(batch.column("code")).fill_null(0).to_numpy(zero_copy_only=False)
                for a, b in stretches(sizes, SCAN_BYTES):  # only a piece of the batch is ever held as Python objects
                    part = batch.slice(a, b - a)
                    texts, langs, known = (part.column(c).to_pylist() for c in ("code", "lang", "owned"))
                    owned = [_owners(text, *indexes[lang], old) if text and lang in indexes else old
                             for text, lang, old in zip(texts, langs, known)]
                    yield pa.record_batch([*part.columns[:3], pa.array(owned, part.schema.field("owned").type)], schema=part.schema)

        state = state.mapInArrow(scan, schema)
    return state.select("doc_id", "lang", F.inline_outer("owned")).filter("line_no is not null").select(
        "doc_id", "lang", "line_no", "ord", "rule_id", "severity", "message", "line")


def _owners(text: str, index: LineIndex, pack: list[tuple], known: list[dict] | None) -> list[dict]:
    """The owners of a text's lines after a block of rules: a line's owner has the least (position, rule_id)."""
    out = {f["line_no"]: f for f in known or []}
    for number, line in enumerate(text.splitlines(), 1):
        found = index.owner(line)
        if found is not None:
            position, rule_id, _, severity, message = pack[found]
            old = out.get(number)
            if old is None or (position, rule_id) < (old["ord"], old["rule_id"]):
                out[number] = {"line_no": number, "ord": position, "rule_id": rule_id, "severity": severity, "message": message,
                               "line": line.strip()}
    return list(out.values())


def _rule_blocks(rules: DataFrame, limit: int) -> Iterator[dict[str, list[tuple]]]:
    """Packs by language, each in order of (position, rule_id), in blocks of about `limit` bytes."""
    rows = rules.select("lang", "ord", "rule_id", "pattern", "severity", "message").where("lang IS NOT NULL AND pattern IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("pattern") + F.octet_length("message") + F.octet_length("rule_id") + 64)).first()[0] or 0
    n = -(-size // limit)
    for k in range(n):
        packs: dict[str, list[tuple]] = {}
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("lang", "ord", "rule_id", "pattern"), F.lit(n)) == k)
        for r in part.collect():
            packs.setdefault(r.lang, []).append((r.ord, r.rule_id, r.pattern, r.severity, r.message))
        yield {lang: sorted(pack) for lang, pack in packs.items()}


def doc_rule_hits(df: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, lang, rule_id): rules matching anywhere in the whole text, each once."""
    return with_hits(df.select("doc_id", "lang", "code"), rules).select(
        "doc_id", "lang", F.explode_outer(M.hit_ids(rules=rules)).alias("rule_id")
    ).filter("rule_id is not null")


def report_text(parts: Column) -> Column:
    return F.when(F.size(parts) == 0, S.CLEAN_REPORT).otherwise(F.array_join(parts, "\n"))


def fault_report(df: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, report): the rule findings of a document as text, row-local."""
    return with_owned_lines(df.select("doc_id", "lang", "code"), rules).select(
        "doc_id", M.report_entries(rules=rules).alias("parts")
    ).select("doc_id", report_text(F.col("parts")).alias("report"))
