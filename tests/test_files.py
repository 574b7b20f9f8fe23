"""Files in and out: paths of any name, quotes in CSV, commits that can be taken up again, stored chains."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from cladeworks import cli
from cladeworks.constants import RANKS
from cladeworks.functions.canonical import canonical_json
from cladeworks.operators import climb, grouping, index, ladder, resolve
from cladeworks.plans import driver_views as V
from cladeworks.schemas import RESPONSE
from cladeworks.sources import csv_scan, entries, files, sinks, store

COLUMNS = ["uuid", "scientific_name", *RANKS, "extra"]
ODD_NAMES = ["my data", "100%", "a%20b", "#1 ü+y", "q[1]{2}*?", "back\\slash'\"", "semi;colon=&"]


def text_of(rows, **kinds):
    out = io.StringIO(newline="")
    csv.writer(out, **kinds).writerows(rows)
    return out.getvalue()


def scan(spark, folder, columns, block):
    found = files.find_inputs(spark, str(folder))
    return csv_scan.read_csv(found.files, columns, block).collect()


PIECES = ["", "a", "plain", '"', '""', ",", "\n", "\r\n", "\r", "é漢😀", " lead", "trail ", "x" * 40, "a,b\nc\"d\"", " "]


@pytest.mark.parametrize("ends", ["\n", "\r\n", "\r"])
def test_csv_equals_pythons_reader(spark, tmp_path, ends):
    rng, expected = random.Random(len(ends)), {}
    for k in range(6):
        rows = [["".join(rng.choice(PIECES) for _ in range(rng.randrange(3))) for _ in range(3)] for _ in range(rng.randrange(1, 12))]
        rows = [r[: rng.choice((1, 2, 3, 3, 3))] for r in rows]
        raw = ("﻿" if k % 2 else "") + "\n" * (k % 3) + text_of([["a", "b c", "d"], *rows], lineterminator=ends, quoting=csv.QUOTE_ALL if k % 3 == 1 else csv.QUOTE_MINIMAL)
        if k == 5:
            raw = raw.rstrip("\r\n")
        (tmp_path / f"{k}.csv").write_bytes(raw.encode())
        read = [r for r in csv.reader(io.StringIO(raw.removeprefix("﻿"), newline="")) if r]
        expected[f"{k}.csv"] = [tuple([*r, None, None, None][:3]) for r in read[1:]]
    for block in (5, 1 << 20):
        got = {}
        for r in sorted(scan(spark, tmp_path, ["a", "b c", "d"], block), key=lambda r: (r.name, r.start)):
            got.setdefault(r.name, []).append((r.a, r["b c"], r.d))
        assert got == {k: v for k, v in expected.items() if v}, block


def test_csv_with_misplaced_quotes(spark, tmp_path):
    raw = 'a,b\n1,5" nail\n2,"x\ny"\n3,say ""hi""\n4,"ab"cd\n5,end"\n'
    (tmp_path / "x.csv").write_text(raw)
    want = [tuple(r) for r in csv.reader(io.StringIO(raw, newline=""))][1:]
    for block in (5, 1 << 20):
        got = scan(spark, tmp_path, ["a", "b", "none"], block)
        assert [(r.a, r.b) for r in got] == want and {r.none for r in got} == {None}
    assert all(r.whole for r in csv_scan.blocks(files.find_inputs(spark, str(tmp_path)).files, 5).collect())


def test_csv_blocks_hold_each_record_once(spark, tmp_path):
    rows = [[str(k), "line\n" * (k % 7), 'q"' * (k % 3)] for k in range(1000)]
    (tmp_path / "x.csv").write_text(text_of([["a", "b", "c"], *rows], lineterminator="\n"))
    found = files.find_inputs(spark, str(tmp_path)).files
    read = csv_scan.read_csv(found, ["a", "b", "c"], 1000)
    assert read.rdd.getNumPartitions() > 10 and sorted((int(r.a), r.b, r.c) for r in read.collect()) == [(int(a), b, c) for a, b, c in rows]
    assert csv_scan.read_csv(found.limit(0), ["a"], 1000).count() == 0


def odd_folder(root, kind, spark):
    """Five rows in a file of each odd name."""
    wanted = {}
    for name in ODD_NAMES:
        for source in ("", f"source={name}/"):
            rows = [[f"{name}|{source}|{k}", "", "Animalia", *[""] * 5, f'Canis "lupus",\n{k}', "e"] for k in range(5)]
            path = root / f"{source}{name} {'in' if source else ''}.{kind}"
            path.parent.mkdir(parents=True, exist_ok=True)
            if kind == "csv":
                path.write_text(text_of([COLUMNS, *rows]))
            else:
                import pyarrow as pa
                import pyarrow.parquet as pq

                pq.write_table(pa.table({c: [r[i] for r in rows] for i, c in enumerate(COLUMNS)}), path)
            wanted[str(path.relative_to(root))] = (rows, name if source else root.name)
    return wanted


@pytest.mark.parametrize("kind", ["csv", "parquet"])
@pytest.mark.parametrize("force", [True, False])
def test_resolve_keeps_all_rows_of_any_path(spark, tmp_path, kind, force):
    root, out = tmp_path / "in %41 #[x]", tmp_path / "out put %20"
    wanted = odd_folder(root, kind, spark)
    spark.createDataFrame([], f"term string, source_id int, response {RESPONSE}").write.parquet(str(tmp_path / "none"))
    args = ["--cache-dir", str(tmp_path / "c"), "resolve", "-i", str(root), "-o", str(out), "--responses", str(tmp_path / "none"), "--output-format", kind, *(["--force-input"] if force else [])]
    assert cli.run_resolve(spark, cli.parser().parse_args(args)) == 0
    for name, (rows, source) in wanted.items():
        path = out / f"{name.removesuffix('.' + kind)}.{'forced' if force else 'resolved'}.{kind}"
        if kind == "csv":
            got = [r for f in path.glob("part-*") for r in csv.DictReader(io.StringIO(f.read_text(), newline=""))]
        else:
            got = [r.asDict() for r in spark.read.parquet(files.literal(str(path))).collect()]
        assert sorted(r["uuid"] for r in got) == [r[0] for r in rows] and {r["source_dataset"] for r in got} == {source}
        assert sorted(r["species"] for r in got) == [r[8] for r in rows]


def test_common_names_keeps_all_rows_of_any_path(spark, tmp_path):
    root, out = tmp_path / "res %41 #[x]", tmp_path / "out put"
    for name in ODD_NAMES:
        rows = spark.createDataFrame([(f"{name}{k}", *["x"] * 7) for k in range(5)], "uuid string, " + ", ".join(f"`{r}` string" for r in RANKS))
        rows.repartition(2).write.parquet(str(root / f"{name}.resolved.parquet"))
    head = ("taxonID", "canonicalName", "taxonRank", "taxonomicStatus", "kingdom", "phylum", "class", "order", "family", "genus")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "Taxon.tsv").write_text("\t".join(head) + "\n" + "\t".join(["1", "x", "species", "accepted", *["x"] * 6]) + "\n")
    (tmp_path / "b" / "VernacularName.tsv").write_text("taxonID\tvernacularName\tlanguage\n1\tthe x\ten\n")
    args = cli.parser().parse_args(["common-names", "--resolved-dir", str(root), "--output-dir", str(out), "--backbone", str(tmp_path / "b")])
    assert cli.run_common_names(spark, args) == 0
    for name in ODD_NAMES:
        got = spark.read.parquet(files.literal(str(out / f"{name}.resolved.parquet"))).collect()
        assert sorted(r.uuid for r in got) == [f"{name}{k}" for k in range(5)] and {r.common_name for r in got} == {"The X"}


def test_lost_rows_are_an_error(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "a", "x")], "file_number long, file_part int, uuid string, outcome string")
    names = spark.createDataFrame([(1, "f.csv")], "file_number long, name string")
    with pytest.raises(RuntimeError, match="1 of 2 rows"):
        sinks.write_by_file(rows, str(tmp_path / "out"), names, lambda n, o: n, 2)
    assert not (tmp_path / "out" / "f.csv").exists()


def test_files_of_other_columns_and_types(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    base = {c: ["v"] for c in COLUMNS if c not in ("uuid", "extra")}
    pq.write_table(pa.table({"uuid": pa.array([7]), **base}), tmp_path / "numbers.parquet")
    pq.write_table(pa.table({**base, "uuid": ["s"], "common_name": ["c"]}), tmp_path / "text [1].parquet")
    got = entries.read_entries(spark, str(tmp_path)).collect()
    assert sorted((r.uuid, r.common_name) for r in got) == [("7", ""), ("s", "c")]
    pq.write_table(pa.table({"uuid": ["s"]}), tmp_path / "bad.parquet")
    assert [sorted(r.missing) for r in entries.validate(entries.find_inputs(spark, str(tmp_path))).collect()] == [sorted(set(base))]
    with pytest.raises(ValueError, match="bad.parquet"):
        entries.read_entries(spark, str(tmp_path))


def test_fingerprints_follow_the_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    look = lambda: (files.fingerprint(files.find_inputs(spark, str(tmp_path))), files.checksum(files.find_inputs(spark, str(tmp_path))))
    first = look()
    assert look() == first
    (tmp_path / "b.csv").write_text("x\n2\n")
    second = look()
    assert second[0] != first[0] and second[1] != first[1]
    (tmp_path / "b.csv").write_text("x\n3\n")
    assert look()[1] != second[1]


def resolved(spark, tmp_path, *more):
    (tmp_path / "in").mkdir(exist_ok=True)
    for k in range(4):
        (tmp_path / "in" / f"f{k}.csv").write_text(text_of([COLUMNS, *[[f"{k}-{i}", "", *[""] * 6, f"S {i}", ""] for i in range(9)]]))
    table = tmp_path / "answers"
    if not table.exists():
        V.responses(spark.createDataFrame([(f"S {i}", s) for i in range(9) for s in (11, 1, 179)], "term string, source_id int")).write.parquet(str(table))
    return cli.parser().parse_args(["--cache-dir", str(tmp_path / "c"), "resolve", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "--responses", str(table), *more])


def test_a_stopped_commit_is_taken_up_again(spark, tmp_path, monkeypatch):
    args, moved, real = resolved(spark, tmp_path), [], store.move

    def once(*a):
        if moved:
            raise OSError("stopped")
        moved.append(a)
        real(*a)

    monkeypatch.setattr(store, "move", once)
    with pytest.raises(OSError, match="stopped"):
        cli.run_resolve(spark, args)
    assert len(list((tmp_path / "out").glob("*.resolved.parquet"))) == 1 and not (tmp_path / "out" / "resolution_stats.json").exists()
    monkeypatch.setattr(store, "move", real)
    assert cli.run_resolve(spark, args) == 0
    got = [r.uuid for r in spark.read.parquet(*[str(p) for p in (tmp_path / "out").glob("*.resolved.parquet")]).collect()]
    assert sorted(got) == sorted(f"{k}-{i}" for k in range(4) for i in range(9))
    assert json.loads((tmp_path / "out" / "resolution_stats.json").read_text())["total_entry_groups_processed"] == 9
    assert not (tmp_path / "out" / ".staging").exists() and not (tmp_path / "out" / ".commit.json").exists()
    assert cli.run_resolve(spark, args) == 0  # refused now, as a run is there


def test_trace_reads_the_stored_chain(spark, tmp_path, capsys, monkeypatch):
    args = resolved(spark, tmp_path)
    assert cli.run_resolve(spark, args) == 0
    trace = cli.parser().parse_args(["--cache-dir", str(tmp_path / "c"), "trace", "entry", "--uuid", "2-3", "--from-input", str(tmp_path / "in"), "--responses", str(tmp_path / "answers"), "--log-level", "ERROR"])
    capsys.readouterr()
    monkeypatch.setattr(resolve, "final_attempts", None)  # nothing is tried again
    assert cli.run_trace(spark, trace) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["entry"]["species"] == "S 3" and said["attempts"][0]["query_term"] == "S 3" and said["group"]["group_count"] == 4


def scanned_files(df):
    """Files that the scans of a plan have read."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
            continue
        if plan.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(plan.plan())
        if plan.getClass().getSimpleName() == "FileSourceScanExec":
            total += plan.metrics().apply("numFiles").value()
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return total


def test_index_prunes_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BUCKET_ROWS", 50)
    rows = spark.createDataFrame([(f"u{i}", None, *[None] * 6, f"S {i % 300}") for i in range(1000)], "uuid string, scientific_name string, " + ", ".join(f"`{r}` string" for r in RANKS))
    groups = grouping.group_entries(rows)
    answers = V.responses(ladder.lookups(groups))
    steps = resolve.with_attempt_keys(resolve.chains(resolve.final_attempts(groups, answers)), answers)
    index.store(str(tmp_path), rows, steps, 1000)
    n = index.buckets_for(1000)
    members, chains = (spark.read.parquet(f"{tmp_path}/{x}-{n}") for x in (index.MEMBERS, index.CHAINS))
    found = index.attempts_of(members, chains, ["u7", "u950", "absent"], n)
    assert n > 20 and scanned_files(members) >= 20 and scanned_files(found) <= 6
    assert "PartitionFilters: [bucket" in found._jdf.queryExecution().toString() or "bucket" in found._jdf.queryExecution().toString()
    want = sorted(map(str, grouping.with_group_key(rows).select("uuid", "group_key").filter("uuid in ('u7', 'u950')").join(steps, "group_key").select(*found.columns).collect()))
    assert sorted(map(str, found.collect())) == want and want
    many = index.attempts_of_many(members, chains, rows.filter("uuid like 'u1%'").select("uuid"), n)
    assert many.select("uuid").distinct().count() == rows.filter("uuid like 'u1%'").count()


def test_attempt_keys_equal_hashlib(spark):
    import hashlib

    rows = spark.createDataFrame([(str(i), None, *[None] * 5, f"G {i}", f"Sé \"{'y' * (i % 20)}{i}\"") for i in range(64)], "uuid string, scientific_name string, " + ", ".join(f"`{r}` string" for r in RANKS))
    groups = grouping.group_entries(rows)
    answers = V.responses(ladder.lookups(groups))
    said = {(r.term, r.source_id): json.dumps(r.response.asDict(True), sort_keys=True) for r in answers.collect()}
    assert len({s.replace(json.dumps(t)[1:-1], "") for (t, _), s in said.items()}) >= 15
    chains = {}
    for r in resolve.with_attempt_keys(resolve.chains(resolve.final_attempts(groups, answers)), answers).orderBy("group_key", "rung").collect():
        parts = [r.group_key, r.query_term, r.query_rank or "", str(r.source_id), said.get((r.query_term, r.source_id), "")]
        assert r.attempt_key == hashlib.sha256("|".join(parts).encode()).hexdigest()
        assert r.previous_key == chains.get(r.group_key)
        chains[r.group_key] = r.attempt_key
    assert len(chains) == 64


def test_canonical_json_equals_pythons(spark):
    rng = random.Random(3)
    numbers = [0.0, -0.0, 1.0, 0.1, 1e7, 1.5e7, 123456789.125, 1e15, 1e16, 1.5e16, 1e-3, 1e-4, 1.5e-4, 1e-5, 1.25e-5, 5e-324, float("inf"), float("-inf"), float("nan"), -1e-7, 2.0**-20, 1e300, None]
    numbers += [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-12, 16) for _ in range(2000)]
    texts = ["", 'a"b\\c', "é ü 漢 😀  ", "\n\r\t\b\f\x00\x1f\x7f", "plain", None, "/ slash"]
    rows = [(x, texts[i % len(texts)], [1, None, i], bool(i % 2), None if i % 5 == 0 else (i, "x")) for i, x in enumerate(numbers)]
    df = spark.createDataFrame(rows, "b_v double, A string, z array<int>, t boolean, s struct<q: long, p: string>")
    for r in df.select(canonical_json(F.struct("*"), df.schema).alias("said"), "*").collect():
        body = r.asDict(True)
        assert body.pop("said") == json.dumps(body, sort_keys=True)


def test_climb_asks_what_groups_come_to(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), "Sci %d" % (i % 5), "K", None, None, None, f"F{i % 3}", f"G{i % 7}", f"S {i}" if i % 2 else None) for i in range(60)] + [("x", *[None] * 8)], "uuid string, scientific_name string, " + ", ".join(f"`{r}` string" for r in RANKS))
    groups = grouping.group_entries(rows)
    calls = []

    def ask(lookups):
        calls.extend((r.term, r.source_id) for r in lookups.collect())
        return V.responses(lookups)

    n = iter(range(1000))
    folder = tmp_path / "kept"

    def keep(name, df):
        path = f"{folder}/{next(n)}-{name}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    got = climb.answers(groups, ask, keep)
    every = V.responses(ladder.lookups(groups))
    assert len(calls) == len(set(calls)) < every.count()
    steps = resolve.chains(resolve.final_attempts(groups, every))
    assert set(calls) == {(r.query_term, r.source_id) for r in steps.filter("query_term <> ''").collect()}
    assert sorted(map(str, resolve.final_attempts(groups, got).collect())) == sorted(map(str, resolve.final_attempts(groups, every).collect()))
    assert climb.answers(groups.limit(0), ask, keep).count() == 0


def test_program_climb_through_the_command(spark, tmp_path):
    from test_resolution import program

    args = resolved(spark, tmp_path)
    args.responses, args.verifier = None, program(tmp_path)
    assert cli.run_resolve(spark, args) == 0
    calls = (tmp_path / "calls.txt").read_text().splitlines()
    assert sorted(calls) == sorted(f"{s} S {i}" for s in (11, 1, 179) for i in range(9))  # nothing is found, so each is asked at each source once
    args.full_rerun, args.verifier = True, program(tmp_path, "lines = lines[1:]")
    with pytest.raises(RuntimeError, match="quarantined"):
        cli.run_resolve(spark, args)
    assert list((tmp_path / "c").glob("*/answers-*/quarantine"))


def test_delta_scans_changed_files_and_resolves_touched_groups(spark, tmp_path):
    from cladeworks.operators.delta import GroupStore

    def write(k, species):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"f{k}.csv").write_text(text_of([COLUMNS, *[[f"{k}-{i}", "", *[""] * 6, x, ""] for i, x in enumerate(species)]]))

    for k in range(10):
        write(k, [f"S {k}", f" s {k} ", f"Common {k % 2}"])
    answers = V.responses(spark.createDataFrame([(t, s) for i in range(12) for t in (f"S {i}", f"Common {i}", f"s {i}") for s in (11, 1, 179)], "term string, source_id int"))
    read_files, kept = [], GroupStore(spark, str(tmp_path / "store"))

    def read(inputs):
        read_files.append(sorted(r["name"] for r in inputs.files.collect()))
        return entries.normalized_entries(entries.read_raw(spark, inputs))

    solve = lambda groups: resolve.final_attempts(groups, answers)

    def check(scanned, resolved):
        got = kept.update(files.find_inputs(spark, str(tmp_path / "in")), read, solve)
        groups = grouping.group_entries(entries.read_entries(spark, str(tmp_path / "in")))
        assert sorted(map(str, got.groups.collect())) == sorted(map(str, groups.collect()))
        assert sorted(map(str, got.final.collect())) == sorted(map(str, solve(groups).select(*got.final.columns).collect()))
        assert (got.scanned, got.resolved) == (scanned, resolved)

    check([f"f{k}.csv" for k in range(10)], 12)
    check([], 0)
    write(3, ["S 11", "Common 1", "Common 1"])
    check(["f3.csv"], 2)  # S 3 went, S 11 came, Common 1 has another count
    (tmp_path / "in" / "f4.csv").unlink()
    check([], 1)
    assert read_files == [[f"f{k}.csv" for k in range(10)], ["f3.csv"]]


def test_a_table_of_one_folder_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(2000).selectExpr("cast(id as string) as uuid", "id as x")
    index._store(rows, "uuid", f"{tmp_path}/t", 1)
    back = spark.read.parquet(f"{tmp_path}/t")
    assert back.count() == 2000 and len(back.inputFiles()) >= 16
