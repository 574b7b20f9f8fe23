"""Where answers come from: a table, JSON lines, an external program, or the local matcher."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import RANKS
from ..schemas import RESPONSE

BATCH = 10_000


def parse_responses(lines: DataFrame, column: str = "value") -> DataFrame:
    """Add ``response`` parsed from JSON; text that is no object, or has no name or match type, gives null."""
    parsed = F.from_json(F.when(F.ltrim(F.col(column)).startswith("{"), F.col(column)), RESPONSE)
    return lines.withColumn("response", F.when(parsed["name"].isNotNull() & parsed["matchType"].isNotNull(), parsed))


def json_responses(spark: SparkSession, path: str, source_id: int) -> DataFrame:
    """``term, source_id, response`` from a file of JSON lines; the last answer to a term counts once."""
    rows = parse_responses(spark.read.text(path)).filter("response is not null")
    return rows.groupBy(F.col("response.name").alias("term")).agg(F.max("value").alias("value")).transform(parse_responses).select("term", F.lit(source_id).alias("source_id"), "response")


def command(program: str, source_id: int, jobs: int = 1, all_matches: bool = True, capitalize: bool = True, species_group: bool = False, fuzzy_uninomial: bool = False, fuzzy_relaxed: bool = False) -> list[str]:
    flags = {"--all_matches": all_matches, "--capitalize": capitalize, "--species_group": species_group, "--fuzzy_uninomial": fuzzy_uninomial, "--fuzzy_relaxed": fuzzy_relaxed}
    return [program, "-j", str(jobs), "--format", "compact", "--sources", str(source_id), *[k for k, on in flags.items() if on]]


def settle(names: list[str], lines: list[str]) -> tuple[list[str | None], int]:
    """The answer line of each name, and how many lines are answers.

    An answer belongs to the name that it repeats, or to one that differs in
    case alone, as a program may capitalise.  Other output and broken JSON are
    no answers.  Where the answers under a name are not as many as the names, none of them counts.
    """
    sent: dict[str, list[int]] = {}
    for k, name in enumerate(names):
        sent.setdefault(name.casefold(), []).append(k)
    got: dict[str, list[tuple[str, str]]] = {}
    for line in lines:
        if line.lstrip().startswith("{"):
            try:
                name = json.loads(line).get("name")
            except ValueError:
                continue
            if isinstance(name, str):
                got.setdefault(name.casefold(), []).append((name, line))
    out: list[str | None] = [None] * len(names)
    received = sum(map(len, got.values()))
    for key, places in sent.items():
        answers = got.get(key, [])
        if len(answers) == len(places):
            exact = [k for k in places if any(n == names[k] for n, _ in answers)]
            for k in [*exact, *[k for k in places if k not in exact]]:
                at = next((i for i, (n, _) in enumerate(answers) if n == names[k]), 0)
                out[k] = answers.pop(at)[1]
    return out, received


def ask(arguments: list[str], names: list[str], tries: int = 3) -> tuple[list[str | None], int, int]:
    """``(answers, lines received, tries)`` of a program for a batch of names; None for a name without exactly one answer.

    A batch is complete if every name has its answer and no other answer came; else it is sent again, ``tries`` times in all.
    """
    for n in range(1, tries + 1):
        done = subprocess.run(arguments, input="\n".join(names), capture_output=True, text=True, check=False)
        if done.returncode:
            raise RuntimeError(f"{arguments[0]} ended with {done.returncode}: {done.stderr[-500:]}")
        answers, received = settle(names, done.stdout.splitlines())
        if None not in answers and received == len(names):
            break
    return answers, received, n


LEDGER = "term string, source_id int, value string, batch string, sent int, received int, tries int, complete boolean"


def program_ledger(lookups: DataFrame, program: str, batch: int = BATCH, tries: int = 3, **options) -> DataFrame:
    """What an external program answers to ``lookups (term, source_id)``, a process per source and batch in each partition.

    Every name has a row, with its batch's numbers of names sent and of
    answers received; no row of a batch is ``complete`` unless the whole batch is.
    """

    def run(batches):
        import uuid

        for b in batches:
            terms, sources = b.column(0).to_pylist(), b.column(1).to_pylist()
            for source in sorted(set(sources)):
                mine = [t for t, s in zip(terms, sources, strict=True) if s == source]
                for i in range(0, len(mine), batch):
                    part = mine[i : i + batch]
                    values, received, n = ask(command(program, source, **options), part, tries)
                    whole, size = None not in values and received == len(part), len(part)
                    yield pa.RecordBatch.from_pydict({
                        "term": part, "source_id": pa.array([source] * size, pa.int32()), "value": pa.array(values, pa.string()), "batch": [uuid.uuid4().hex] * size,
                        "sent": pa.array([size] * size, pa.int32()), "received": pa.array([received] * size, pa.int32()), "tries": pa.array([n] * size, pa.int32()), "complete": [whole] * size,
                    })

    return lookups.select("term", F.col("source_id").cast("int")).mapInArrow(run, LEDGER)


class IncompleteAnswers(RuntimeError):
    """A program did not answer each name once."""


def answers_of(ledger: DataFrame) -> DataFrame:
    """``term, source_id, response`` of a ledger; reading a row of an incomplete batch is an error.  An answer without name or type has a null response."""
    said = F.concat(F.lit("the verifier gave "), F.col("received").cast("string"), F.lit(" answers to "), F.col("sent").cast("string"), F.lit(" names of one batch"))
    return parse_responses(ledger.withColumn("value", F.when(F.col("complete"), F.col("value")).otherwise(F.raise_error(said)))).select("term", "source_id", "response")


def quarantine(ledger: DataFrame, keep: Callable[[DataFrame], object]) -> None:
    """Raise if a stored ledger has incomplete batches, after giving their rows to ``keep``."""
    broken = ledger.filter(~F.col("complete"))
    names, batches = broken.agg(F.count("*"), F.count_distinct("batch")).first()
    if names:
        keep(broken)
        raise IncompleteAnswers(f"{batches} batches with {names} names were not answered in full; they are quarantined")


def program_responses(lookups: DataFrame, program: str, batch: int = BATCH, tries: int = 3, **options) -> DataFrame:
    """``term, source_id, response`` from an external program; an incomplete batch is an error."""
    return answers_of(program_ledger(lookups, program, batch, tries, **options))


def _pieces(name: str, most_edits: int) -> str:
    """Keys of a stored name in SQL: its length, and each of ``most_edits + 1`` consecutive parts with its number."""
    n, k = f"length({name})", most_edits
    at = f"cast(i * {n} div {k + 1} as int)"
    return f"transform(sequence(0, {k}), i -> named_struct('n', {n}, 'i', i, 'piece', substring({name}, {at} + 1, cast((i + 1) * {n} div {k + 1} as int) - {at})))"


def _probes(term: str, most_edits: int) -> str:
    """Keys that a name within ``most_edits`` edits of a term can have: edits leave one of its parts whole and move it by as many places at most."""
    m, k = f"length({term})", most_edits
    at, size = f"cast(i * n div {k + 1} as int) + s", f"(cast((i + 1) * n div {k + 1} as int) - cast(i * n div {k + 1} as int))"
    piece = f"case when {at} between 0 and {m} - {size} then substring({term}, {at} + 1, {size}) end"
    keys = f"transform(sequence(-{k}, {k}), s -> named_struct('n', n, 'i', i, 'piece', {piece}))"
    of_length = f"flatten(transform(sequence(0, {k}), i -> {keys}))"
    return f"filter(array_distinct(flatten(transform(sequence(greatest(0, {m} - {k}), {m} + {k}), n -> {of_length}))), x -> x.piece is not null)"


def near_names(terms: DataFrame, names: DataFrame, most_edits: int = 2) -> DataFrame:
    """``source_id, term, canonical, edits`` for every different name of ``names (source_id, canonical)`` within 1 to ``most_edits`` edits of a term."""
    stored = names.select("source_id", "canonical").distinct().withColumn("key", F.explode(F.expr(_pieces("canonical", most_edits)))).select("source_id", "canonical", "key.*")
    asked = terms.select("source_id", "term").distinct().withColumn("key", F.explode(F.expr(_probes("term", most_edits)))).select("source_id", "term", "key.*")
    pairs = asked.join(stored, ["source_id", "n", "i", "piece"]).withColumn("edits", F.levenshtein("term", "canonical", most_edits))
    return pairs.filter(F.col("edits").between(1, most_edits)).select("source_id", "term", "canonical", "edits").distinct()


def match_locally(lookups: DataFrame, taxa: DataFrame, most_edits: int = 2) -> DataFrame:
    """An approximation of the external program over a backbone table.

    Exact by canonical name, else Fuzzy with every name within ``most_edits``
    edits, else PartialExact on the genus of a binomial.  Each row of ``taxa``
    with a matching name is a result of its own.  Answers come from one source table, given as ``taxa`` with
    ``source_id, taxonID, canonicalName, taxonomicStatus`` and ranks.
    """
    ranks = F.lit("|".join(RANKS))
    path = F.array_join(F.array(*[F.coalesce(F.col(c) if c in taxa.columns else F.lit(None).cast("string"), F.lit("")) for c in RANKS]), "|")
    record = taxa.select(
        "source_id", F.col("canonicalName").alias("canonical"), F.col("taxonID").cast("string").alias("recordId"), path.alias("path"),
        F.when(F.lower("taxonomicStatus") == "accepted", "Accepted").otherwise("Synonym").alias("taxonomicStatus"),
    )
    asked = lookups.withColumn("genus", F.substring_index("term", " ", 1))
    exact = asked.join(record, (asked["term"] == record["canonical"]) & (asked["source_id"] == record["source_id"])).select(asked["term"], asked["source_id"], "canonical", "recordId", "path", "taxonomicStatus", F.lit("Exact").alias("how"), F.lit(0).alias("edits"))
    left = asked.join(exact.select("term", "source_id").distinct(), ["term", "source_id"], "left_anti")
    fuzzy = near_names(left, record, most_edits).join(record, ["source_id", "canonical"]).select("term", "source_id", "canonical", "recordId", "path", "taxonomicStatus", F.lit("Fuzzy").alias("how"), "edits")
    rest = left.join(fuzzy.select("term", "source_id").distinct(), ["term", "source_id"], "left_anti").filter("genus <> term")
    partial = rest.join(record, (rest["genus"] == record["canonical"]) & (rest["source_id"] == record["source_id"])).select("term", rest["source_id"], "canonical", "recordId", "path", "taxonomicStatus", F.lit("PartialExact").alias("how"), F.lit(0).alias("edits"))
    every = exact.unionByName(fuzzy).unionByName(partial)
    null = lambda kind: F.lit(None).cast(kind)
    result = F.struct(
        F.col("source_id").cast("int").alias("dataSourceId"), F.lit("local").alias("dataSourceTitleShort"), "recordId", F.col("canonical").alias("matchedName"),
        F.col("canonical").alias("matchedCanonicalSimple"), F.col("recordId").alias("currentRecordId"), F.col("canonical").alias("currentName"), "taxonomicStatus",
        (F.col("taxonomicStatus") != "Accepted").alias("isSynonym"), F.col("path").alias("classificationPath"), ranks.alias("classificationRanks"),
        F.col("edits").cast("int").alias("editDistance"), F.col("how").alias("matchType"),
        F.struct(null("double").alias("infraSpecificRankScore"), F.lit(1.0).alias("parsingQualityScore")).alias("scoreDetails"),
    )
    grouped = every.groupBy("term", "source_id").agg(F.array_sort(F.collect_list(F.struct("edits", "recordId", result.alias("r")))).alias("rows"), F.min("how").alias("how"))
    answer = F.struct(F.col("term").alias("name"), F.col("how").alias("matchType"), F.transform("rows", lambda x: x["r"]).alias("results"))
    return grouped.select("term", "source_id", answer.alias("response"))
