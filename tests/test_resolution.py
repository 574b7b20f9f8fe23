"""The cascade against a row-at-a-time version of its specification, and the operators around it."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cladeworks.constants import FORCED_INPUT, INVALID, KINGDOMS, RANKS, SUCCESSFUL
from cladeworks.functions import names as N
from cladeworks.operators import common_names, grouping, ladder, resolve
from cladeworks.schemas import RESPONSE
from cladeworks.sources import entries, sinks

ENTRY = "uuid string, scientific_name string, " + ", ".join(f"`{r}` string" for r in RANKS)


def ok(x):
    return (x or "").strip().lower() not in INVALID


def canonical(x):
    return None if not ok(x) else KINGDOMS.get(x.strip().lower(), x.strip())


def lineage(r):
    out = [None] * 7
    if r["classificationPath"] and r["classificationRanks"]:
        for k, t in zip(r["classificationRanks"].split("|"), r["classificationPath"].split("|"), strict=False):
            if k in RANKS:
                out[RANKS.index(k)] = t
    return out


def agrees(e, c, upto):
    return upto is not None and any(e) and all(x is None or x == y for i, (x, y) in enumerate(zip(e, c, strict=True)) if i <= upto)


def rank_of(term, c):
    hits = [i for i, x in enumerate(c) if x is not None and x.strip() == term]
    return max(hits, default=None)


def expected(group, q, rank, retry, response):
    """(status, lineage) of one rung by the rules in order."""
    raw = [group[r] or "" for r in RANKS]
    if all((group[c] or "") in INVALID for c in ("scientific_name", *RANKS)):
        return "EMPTY_INPUT_TAXONOMY", None
    e = [x.strip() if ok(x) else None for x in raw]
    m = response["matchType"] if response else None
    rs = (response or {}).get("results") or []
    c = [lineage(r) for r in rs]
    n, first = len(rs), (rs[0] if rs else None)
    rk = rank_of(q, raw) if q else None
    qr = RANKS.index(rank) if rank in RANKS else None
    top = next((group[x].strip() for x in ("species", "scientific_name", *RANKS[5::-1]) if ok(group[x])), None)
    prim = [i for i in range(n) if rs[i]["dataSourceId"] == 11]
    acc = [i for i in prim if rs[i]["taxonomicStatus"] == "Accepted"]
    can = lambda i: rs[i]["matchedCanonicalSimple"]
    cut = lambda x, k: [y if i <= k else None for i, y in enumerate(x)]
    one = n == 1 and first["matchType"] == "Exact" and first["taxonomicStatus"] == "Accepted" and first["dataSourceId"] == 11
    if one:
        if agrees(e, c[0], 6) and q == top:
            return "EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED", c[0]
        return ("EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_SIMPLE", c[0]) if any(c[0]) else ("FAILED", None)
    lost = lambda s, x: (s, x) if any(x) else ("FAILED", None)
    same = acc and all(can(i) == can(acc[0]) for i in acc)
    pair = n == 2 and all(rs[i]["matchType"] == "Exact" and rs[i]["dataSourceId"] == 11 for i in (0, 1)) and can(0) and can(0) == can(1) == q
    if n > 1 and m == "Exact" and sum(rs[i]["matchType"] is not None for i in prim) > 1 and sum(rs[i]["matchType"] is not None for i in acc) == 1:
        return lost("EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_AMONG_SYNONYMS_SIMPLE", c[next(i for i in acc if rs[i]["matchType"] is not None)])
    if n >= 2 and m == "Exact" and len(acc) >= 2 and same:
        for i in acc:
            if rs[i]["matchedName"] == q:
                return lost("EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_AUTHOR_DISAMBIGUATION", c[i])
    if pair and len(acc) == 2:
        k = canonical(e[0])
        hits = [i for i in (0, 1) if agrees(e, c[i], 6)]
        if k and any(canonical(c[i][0]) == k for i in (0, 1)) and len(hits) == 1:
            return "EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_INNER_RANK_DISAMBIGUATION", c[hits[0]]
        hits = [i for i in (0, 1) if rank_of(q, c[i]) == rk]
        if rk is not None and all(agrees(e, x, rk) for x in c) and len(hits) == 1:
            return "EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_RANK_LEVEL_DISAMBIGUATION", cut(c[hits[0]], rk)
    if pair and len(acc) == 1 and any(r["taxonomicStatus"] == "Synonym" for r in rs) and agrees(e, c[acc[0]], rk):
        return "EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_SYNONYM_DISAMBIGUATION", cut(c[acc[0]], rk)
    if n and m == "Exact" and rk is not None:
        cands = [i for i in acc if can(i) == q and agrees(e, c[i], rk) and any(c[i]) and rank_of(q, c[i]) == rk]
        if cands:
            best = next((i for i in cands if (rs[i]["scoreDetails"] or {}).get("parsingQualityScore") == 1), cands[0])
            return "EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_MULTI_RESULT_DISAMBIGUATION", cut(c[best], rk)
    if n >= 2 and m == "Exact" and len(acc) >= 2 and same:
        hit = next((i for i in acc if (rs[i]["currentName"] or "").strip() == q.strip()), None)
        if hit is None and len({rs[i]["classificationPath"] for i in acc if rs[i]["classificationPath"]}) == 1:
            hit = acc[0]
        if hit is not None:
            return lost("EXACT_MATCH_PRIMARY_SOURCE_MULT_ACCEPTED", c[hit])
    if n >= 2 and m == "Exact" and len(prim) >= 2 and all(rs[i]["taxonomicStatus"] == "Synonym" for i in prim) and len({rs[i]["currentName"] for i in prim}) == 1:
        scores = [((rs[i]["scoreDetails"] or {}).get("infraSpecificRankScore"), i) for i in prim]
        best = max((s for s, _ in scores if s is not None), default=-1)
        if best > -1:
            return lost("MULTI_EXACT_MATCH_PRIMARY_SOURCE_SYNONYMS_INFRASPECIFIC_SCORE", c[next(i for s, i in scores if s == best)])
    if n >= 2 and m == "Exact" and len(acc) >= 2:
        tops = {i: rs[i]["classificationPath"].split("|")[0] for i in acc if "|" in (rs[i]["classificationPath"] or "")}
        hit = next((i for i, t in tops.items() if canonical(t) == canonical(raw[0]) and canonical(t)), None)
        if len(set(tops.values())) >= 2 and hit is not None:
            return lost("MULTI_EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_HOMONYM", c[hit])
        if any(e):
            def score(x):
                return sum(bool(a and b) and ((canonical(a) is not None and canonical(a) == canonical(b)) if k == 0 else a.lower() == b.lower()) for k, (a, b) in enumerate(zip(e, x, strict=True)))

            most = max(score(c[i]) for i in acc)
            hits = [i for i in acc if score(c[i]) == most]
            return ("EXACT_MATCH_PRIMARY_SOURCE_MULTI_ACCEPTED_TAXONOMIC_MATCH", c[hits[0]]) if len(hits) == 1 else ("FAILED", None)
    if n == 1 and m == "Fuzzy" and acc:
        if qr and agrees(e, c[0], qr - 1):
            return "FUZZY_MATCH_PRIMARY_SOURCE_ACCEPTED", c[0]
        return lost("SINGLE_FUZZY_MATCH_PRIMARY_SOURCE_ACCEPTED_SIMPLE", c[0])
    if n and m == "PartialExact":
        cands = []
        for i in acc:
            own = rank_of(can(i), c[i]) if can(i) else None
            if own and raw[own].strip().startswith(can(i)) and agrees(e, c[i], own - 1):
                cands.append((i, own))
        if cands:
            i, own = next(((i, o) for i, o in cands if (rs[i]["scoreDetails"] or {}).get("parsingQualityScore") == 1), cands[0])
            return "PARTIAL_EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED_DISAMBIGUATED", cut(c[i], own)
        if n == 1 and prim:
            return ("FAILED", None) if can(0) is None and any(raw) else lost("PARTIAL_EXACT_MATCH_PRIMARY_SOURCE_SIMPLE", c[0])
    if n == 1 and m == "Exact" and prim and first["taxonomicStatus"] == "Synonym" and can(0) and (q.startswith(can(0)) or raw[6].startswith(can(0))) and first["currentName"] and first["classificationPath"]:
        return lost("EXACT_MATCH_PRIMARY_SOURCE_SYNONYM_SIMPLE", c[0])
    if q.strip() and (response is None or m == "NoMatch" or n == 0):
        return "RETRY_SCHEDULED", None
    if response is None:
        return "FAILED", None
    if retry and n == 1 and first["matchType"] == "Exact" and first["taxonomicStatus"] == "Accepted" and first["dataSourceId"] == 1 and can(0) == q and any(c[0]) and rk is not None and agrees(e, c[0], rk):
        return "EXACT_MATCH_SECONDARY_SOURCE_ACCEPTED_PRUNED", c[0]
    return "FORCE_ACCEPTED", [x or None for x in raw]


def random_response(rng, term, group):
    m = rng.choice(["Exact"] * 6 + ["Fuzzy", "PartialExact", "PartialExact", "NoMatch", "Virus"])
    own = [group[r].strip() if group[r] and rng.random() < 0.85 else rng.choice(["Animalia", "Other", "Homo"]) for r in RANKS]
    results = []
    synonyms = rng.random() < 0.25
    for i in range(rng.choice([0, 1, 1, 1, 2, 2, 3]) if m != "NoMatch" else 0):
        path = [*own[:5], *(own[5:] if rng.random() < 0.8 else ["X", "X y"])]
        if rng.random() < 0.3:
            path[0] = rng.choice(["Animalia", "Metazoa", "Plantae", "Fungi"])
        if rng.random() < 0.2:
            path[rng.randrange(7)] = "Changed"
        ranks = list(RANKS)
        if rng.random() < 0.2:
            k = rng.randrange(7)
            del ranks[k], path[k]
        if rng.random() < 0.1:
            ranks.append("class")
        empty = rng.random() < 0.08
        results.append({
            "dataSourceId": rng.choice([11] * 6 + [1]), "dataSourceTitleShort": "T", "recordId": f"r{i}", "matchedName": rng.choice([term, f"{term} L.", "other"]),
            "matchedCanonicalSimple": rng.choice([term] * 6 + [term.split(" ")[0], "", None, "zzz"]), "currentRecordId": "c", "currentName": rng.choice([term, "current", "", None]),
            "taxonomicStatus": "Synonym" if synonyms else rng.choice(["Accepted"] * 5 + ["Synonym", "Doubtful", None]), "isSynonym": synonyms,
            "classificationPath": rng.choice(["", None]) if empty else "|".join(path), "classificationRanks": "|".join(ranks), "editDistance": 1,
            "matchType": rng.choice([m] * 8 + [None]), "scoreDetails": rng.choice([None, {"infraSpecificRankScore": rng.choice([None, 0.0, 0.5]), "parsingQualityScore": rng.choice([0.0, 1.0])}]),
        })
    return {"name": term, "matchType": m, "results": results}


def random_groups(rng, n):
    base = ["Animalia", "Chordata", "Mammalia", "Primates", "Hominidae", "Homo", "Homo sapiens"]
    rows = []
    for i in range(n):
        names = [x if rng.random() < 0.75 else rng.choice([None, "", "Unknown", " "]) for x in base]
        names = [f" {x} " if x and rng.random() < 0.05 else x for x in names]
        names[6] = names[6] and f"Homo s{i}"
        if rng.random() < 0.2:
            names[0] = "Metazoa"
        if rng.random() < 0.04:
            names = [rng.choice(["", "null", None])] * 7
        rows.append((str(i), rng.choice([None, f"Homo s{i}", f"Homo t{i}"]) if any(names) else None, *names))
    return rows


def test_cascade_against_the_specification(spark):
    rng = random.Random(11)
    df = spark.createDataFrame(random_groups(rng, 1500), ENTRY)
    groups = grouping.group_entries(df)
    climbed = ladder.rungs(groups).collect()
    answers = {}
    for r in climbed:
        if r.query_term and (r.query_term, r.source_id) not in answers and rng.random() < 0.8:
            answers[r.query_term, r.source_id] = random_response(rng, r.query_term, r.asDict())
    table = spark.createDataFrame([(t, s, json.dumps(a)) for (t, s), a in answers.items()], "term string, source_id int, j string").select("term", "source_id", F.from_json("j", RESPONSE).alias("response"))
    tried = resolve.attempts(groups, table).collect()
    assert len(tried) == len(climbed)
    seen, first = Counter(), {}
    for r in sorted(tried, key=lambda r: r.rung):
        status, found = expected(r.asDict(), r.query_term, r.query_rank, r.is_retry, answers.get((r.query_term, r.source_id)))
        assert (r.status, r.resolved) == (status, found), (r, answers.get((r.query_term, r.source_id)))
        seen[status] += 1
        if r.group_key not in first or first[r.group_key][1] == "RETRY_SCHEDULED":
            first[r.group_key] = (r.rung, status)
    assert len(seen) >= 18, seen
    final = resolve.final_attempts(groups, table)
    for r in final.collect():
        rung, status = first[r.group_key]
        assert (r.rung, r.status) == (rung, "NO_MATCH_RETRIES_EXHAUSTED" if status == "RETRY_SCHEDULED" else status)
    steps = sorted(resolve.with_attempt_keys(resolve.chains(final), table).collect(), key=lambda r: (r.group_key, r.rung))
    assert len(steps) == sum(r + 1 for r, _ in first.values()) and len({r.attempt_key for r in steps}) == len(steps)
    for before, r in zip([None, *steps], steps, strict=False):
        rung, status = first[r.group_key]
        assert r.status == ("RETRY_SCHEDULED" if r.rung < rung else "NO_MATCH_RETRIES_EXHAUSTED" if status == "RETRY_SCHEDULED" else status)
        assert r.previous_key == (before.attempt_key if r.rung else None)
    asked = {(r.group_key, r.rung): (r.query_term, r.query_rank, r.source_id) for r in climbed}
    assert all(asked[r.group_key, r.rung] == (r.query_term, r.query_rank, r.source_id) for r in [*steps, *final.collect()])
    rows = resolve.resolve(df, table).collect()
    assert len(rows) == df.count()
    assert all((r.resolution_path == "UNSOLVED") == (r.resolution_status not in SUCCESSFUL) for r in rows)
    assert {"EMPTY_INPUT_TAXONOMY", FORCED_INPUT} <= {r.resolution_status for r in rows}
    stats = resolve.statistics(resolve.force_failed(final)).first()
    assert stats.total_entry_groups_processed == groups.count() and stats.total_attempts_created == sum(r + 1 for r, _ in first.values())


def test_names(spark):
    rows = ["drone-bee", "UNDERWING, tiger, and allied moths", "o'brien 2nd", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(N.title_case(F.col("x"))).collect()]
    assert got == ["Drone-Bee", "Underwing, Tiger, And Allied Moths", "O'Brien 2nd", None]
    kinds = spark.createDataFrame([(x,) for x in ("metazoa ", "Viridiplantae", "Xenia", "N/A", None)], "x string").select(N.canonical_kingdom(F.col("x"))).collect()
    assert [r[0] for r in kinds] == ["Animalia", "Plantae", "Xenia", None, None]


def test_group_key_equals_hashlib(spark):
    import hashlib

    df = spark.createDataFrame([("1", " Homo Sapiens", "Animalia", None, "Mammalia", None, None, "Homo", "Homo sapiens ")], ENTRY)
    key = df.select(N.group_key()).first()[0]
    assert key == hashlib.sha256(b"homo sapiens|homo sapiens|homo|||mammalia||animalia").hexdigest()


TAXA = [("100", "Canis lupus", "species", "Animalia", "Chordata", "Mammalia", "Carnivora", "Canidae", "Canis"), ("300", "Canis", "genus", "Animalia", "Chordata", "Mammalia", "Carnivora", "Canidae", None), ("400", "Canidae", "family", "Animalia", "Chordata", "Mammalia", "Carnivora", None, None)]


def annotated(spark, *rows):
    return spark.createDataFrame(list(rows), "uuid string, common_name string, species string, genus string, family string, `order` string, class string, phylum string, kingdom string")


def backbone(spark):
    return spark.createDataFrame(TAXA, "taxonID string, canonicalName string, taxonRank string, kingdom string, phylum string, class string, `order` string, family string, genus string")


@pytest.mark.parametrize("climb,species,name,rank", [(True, "Canis lupus", "Dog Genus", "genus"), (False, "Canis lupus", None, None), (False, None, "Dog Genus", "genus"), (True, "unknown", "Dog Genus", "genus")])
def test_common_names(spark, climb, species, name, rank):
    rows = annotated(spark, ("u", "BAD INPUT", species, "Canis", "Canidae", "Carnivora", "Mammalia", "Chordata", "Animalia"))
    names = spark.createDataFrame([("300", "Dog Genus"), ("400", "Dogs")], "taxonID string, vernacularName string")
    out = common_names.add_common_names(rows, backbone(spark), names, climb)
    assert sorted(out.columns) == sorted([*rows.columns, "common_name_rank"])
    r = out.first()
    assert (r.common_name, r.common_name_rank) == (name, rank)


def test_taxon_ids(spark):
    full = ("u", None, "Canis lupus", "Canis", "Canidae", "Carnivora", "Mammalia", "Chordata", "Animalia")
    r = common_names.merge_taxon_ids(annotated(spark, full), backbone(spark)).first()
    assert (r.taxonID_species, r.taxonID_genus) == ("100", "300")
    r = common_names.merge_taxon_ids(annotated(spark, ("u", None, None, "", *full[4:])), backbone(spark)).first()
    assert (r.taxonID_species, r.taxonID_genus) == (None, None)


def test_vernacular_priority(spark):
    rows = [("1", "loup", "fr"), ("1", "gray wolf", "en"), ("2", "HOUSE CAT", "en"), ("3", "roble blanco", "es"), ("3", "quercia", "it"), ("4", "x", None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "taxonID string, vernacularName string, language string, i long")
    got = {r.taxonID: r.vernacularName for r in common_names.prioritize_vernacular(df, F.col("i")).collect()}
    assert got == {"1": "Gray Wolf", "2": "House Cat", "3": "Roble Blanco"}


def test_files(spark, tmp_path):
    folder = tmp_path / "source=alpha"
    folder.mkdir()
    (folder / "a.csv").write_text("uuid,kingdom,phylum,class,order,family,genus,species,scientific_name,extra\n001,Animalia,,,,,,Homo sapiens,,z\n,Plantae,,,,,,,,\n")
    rows = entries.read_entries(spark, str(tmp_path)).collect()
    assert [(r.uuid, r.species, r.phylum, r.source_dataset) for r in rows] == [("001", "Homo sapiens", "", "alpha")]
    (tmp_path / "bad.csv").write_text("uuid,kingdom\n1,A\n")
    with pytest.raises(ValueError):
        entries.read_entries(spark, str(tmp_path))
    with pytest.raises(ValueError):
        entries.find_inputs(spark, str(tmp_path / "nothing"))
    (tmp_path / "counted").mkdir()
    (tmp_path / "counted" / "x.csv").write_text("uuid,kingdom,phylum,class,order,family,genus,species,scientific_name\n1,,,,,,,,\n,,,,,,,,\n")
    assert entries.count_entries(spark, str(tmp_path / "counted")) == 2


def test_manifest_deletes_only_inside(spark, tmp_path):
    out, outside = tmp_path / "out", tmp_path / "outside.txt"
    out.mkdir()
    outside.write_text("keep")
    (out / "a.resolved.csv").write_text("x")
    (out / "link").symlink_to(outside)
    sinks.write_manifest(spark, str(out), "resolve", "in", ["a.resolved.csv", "../outside.txt", str(outside), "link", 42, None])
    assert sinks.already_run(spark, str(out))
    assert sinks.delete_listed(spark, str(out), "resolve") == ["a.resolved.csv"] and outside.exists()
    (out / "cladeworks_resolve_manifest.json").write_text("{")
    assert sinks.read_manifest(spark, str(out), "resolve") is None and sinks.delete_listed(spark, str(out), "resolve") == []


def test_command_line(spark, tmp_path, capsys):
    from cladeworks import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s.csv").write_text("uuid,kingdom,phylum,class,order,family,genus,species,scientific_name\n1,Animalia,,,,,,Homo sapiens,\n2,,,,,,,,\n")
    answer = {"name": "Homo sapiens", "matchType": "Exact", "results": [{"dataSourceId": 11, "matchedCanonicalSimple": "Homo sapiens", "taxonomicStatus": "Accepted", "matchType": "Exact", "classificationPath": "Animalia|Homo sapiens", "classificationRanks": "kingdom|species"}]}
    spark.createDataFrame([("Homo sapiens", 11, json.dumps(answer))], "term string, source_id int, j string").select("term", "source_id", F.from_json("j", RESPONSE).alias("response")).write.parquet(str(tmp_path / "answers"))
    here = ["--cache-dir", str(tmp_path / "cache")]
    args = cli.parser().parse_args([*here, "resolve", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "--responses", str(tmp_path / "answers")])
    assert cli.run_resolve(spark, args) == 0
    rows = spark.read.parquet(str(tmp_path / "out" / "s.resolved.parquet")).collect()
    assert [(r.uuid, r.resolution_status) for r in rows] == [("1", "EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED")]
    assert [r.uuid for r in spark.read.parquet(str(tmp_path / "out" / "s.unsolved.parquet")).collect()] == ["2"]
    stats = json.loads((tmp_path / "out" / "resolution_stats.json").read_text())
    assert stats["total_entry_groups_processed"] == 2 and stats["final_status_empty_input_taxonomy"] == 1
    assert cli.run_resolve(spark, args) == 0
    trace = cli.parser().parse_args(["trace", "entry", "--uuid", "1", "--from-input", str(tmp_path / "in"), "--responses", str(tmp_path / "answers"), "--format", "text", "--verbose"])
    capsys.readouterr()
    assert cli.run_trace(spark, trace) == 0
    said = capsys.readouterr().out
    assert "Attempt 1" in said and "status: EXACT_MATCH_PRIMARY_SOURCE_ACCEPTED" in said and said.splitlines()[-1].startswith("member ") and said.splitlines()[-1].endswith(" 1")
    trace.uuid = "absent"
    assert cli.run_trace(spark, trace) == 1
    # A rerun replaces the files and the stored tables; stored tables can be described and removed.
    marker = next((tmp_path / "cache").glob("*/groups/_SUCCESS"))
    marker.write_text("old")
    args.full_rerun = True
    assert cli.run_resolve(spark, args) == 0 and next((tmp_path / "cache").glob("*/groups/_SUCCESS")).read_text() == ""
    assert [r.uuid for r in spark.read.parquet(str(tmp_path / "out" / "s.resolved.parquet")).collect()] == ["1"]
    capsys.readouterr()
    alone = lambda *a: cli.run_alone(lambda: spark, cli.parser().parse_args([*here, *a]))
    assert alone("--cache-stats", "--cache-input", str(tmp_path / "in")) == 0 and json.loads(capsys.readouterr().out)[0]["tables"].count("groups") == 1
    assert alone("--clear-cache") == 0 and not list((tmp_path / "cache").glob("*/groups"))
    assert alone("--show-config") == 0 and "batch_size: 10000" in capsys.readouterr().out
    assert alone("--show-cache-path") == 0 and capsys.readouterr().out.strip() == str(tmp_path / "cache")
    assert alone() is None


def test_one_write_serves_all_files(spark, tmp_path):
    from cladeworks import cli

    for k in range(5):
        folder = tmp_path / "in" / f"source=s{k}"
        folder.mkdir(parents=True)
        (folder / "f.csv").write_text("uuid,kingdom,phylum,class,order,family,genus,species,scientific_name\n" + "".join(f"{k}-{i},Animalia,,,,,,Homo s{i},\n" for i in range(20)))
    args = cli.parser().parse_args(["--cache-dir", str(tmp_path / "c"), "resolve", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "--output-format", "csv", "--force-input"])
    assert cli.run_resolve(spark, args) == 0
    for k in range(5):
        rows = spark.read.csv(str(tmp_path / "out" / f"source=s{k}" / "f.forced.csv"), header=True).collect()
        assert sorted(r.uuid for r in rows) == sorted(f"{k}-{i}" for i in range(20)) and {r.source_dataset for r in rows} == {f"s{k}"}
        assert not {"file_number", "file_part", "outcome"} & set(rows[0].asDict())
    assert not (tmp_path / "out" / ".staging").exists()
    listed = sinks.read_manifest(spark, str(tmp_path / "out"), "resolve")["files"]
    assert sorted(sinks.delete_listed(spark, str(tmp_path / "out"), "resolve")) == sorted(listed)


def test_common_names_command(spark, tmp_path):
    import zipfile

    from cladeworks import cli

    columns = "uuid string, common_name string, species string, genus string, family string, `order` string, class string, phylum string, kingdom string"
    full = ("Canis lupus", "Canis", "Canidae", "Carnivora", "Mammalia", "Chordata", "Animalia")
    for name in ("a", "b/c"):
        spark.createDataFrame([(name, "BAD", *full)], columns).write.parquet(str(tmp_path / "in" / f"{name}.resolved.parquet"))
    head = ("taxonID", "canonicalName", "taxonRank", "taxonomicStatus", "kingdom", "phylum", "class", "order", "family", "genus")
    taxon = ("100", "Canis lupus", "species", "accepted", "Animalia", "Chordata", "Mammalia", "Carnivora", "Canidae", "Canis")
    with zipfile.ZipFile(tmp_path / "backbone.zip", "w") as z:
        z.writestr("deep/taxon.TSV", "\t".join(head) + "\n" + "\t".join(taxon) + "\n")
        z.writestr("VernacularName.tsv", "taxonID\tvernacularName\tlanguage\n100\tgray wolf\ten\n")
    args = cli.parser().parse_args(["common-names", "--resolved-dir", str(tmp_path / "in"), "--output-dir", str(tmp_path / "out"), "--backbone", str(tmp_path / "backbone.zip"), "--least-archive-bytes", "10"])
    assert cli.run_common_names(spark, args) == 0
    for name in ("a", "b/c"):
        rows = spark.read.parquet(str(tmp_path / "out" / f"{name}.resolved.parquet")).collect()
        assert [(r.uuid, r.common_name, r.common_name_rank) for r in rows] == [(name, "Gray Wolf", "species")]


def test_backbone_archives_are_checked(tmp_path):
    import zipfile

    from cladeworks.sources import backbone as B

    with zipfile.ZipFile(tmp_path / "small.zip", "w") as z:
        z.writestr("Taxon.tsv", "x")
    with pytest.raises(FileNotFoundError):
        B.unpack(str(tmp_path / "small.zip"), str(tmp_path / "x"))
    with pytest.raises(ValueError):
        B.unpack(str(tmp_path / "small.zip"), str(tmp_path / "y"), B.WHOLE_ARCHIVE)
    assert not (tmp_path / "small.zip").exists()
    (tmp_path / "broken.zip").write_text("no archive")
    with pytest.raises(zipfile.BadZipFile):
        B.unpack(str(tmp_path / "broken.zip"), str(tmp_path / "z"))
    assert not (tmp_path / "broken.zip").exists()


def test_stored_tables_age(spark, tmp_path):
    import os

    from cladeworks.sources.store import TableCache, namespace

    made = []
    compute = lambda: (made.append(1), spark.range(len(made)))[1]
    cache = TableCache(spark, str(tmp_path), namespace("resolve", "abc" * 10), 100)
    assert cache.table("t", compute).count() == 1 and cache.table("t", compute).count() == 1
    assert cache.table("t", compute, refresh=True).count() == 2
    old = tmp_path / namespace("resolve", "abc" * 10) / "t" / "_SUCCESS"
    os.utime(old, (1, 1))
    assert cache.table("t", compute).count() == 3
    old.unlink()
    assert cache.table("t", compute).count() == 4
    assert cache.stats()["entry_count"] == 1 and cache.clear() == 1 and not cache.used()


PROGRAM = """#!/usr/bin/env python3
import json, os, sys
names = sys.stdin.read().split("\\n")
with open(os.path.dirname(__file__) + "/calls.txt", "a") as f:
    for n in names:
        f.write(sys.argv[sys.argv.index("--sources") + 1] + " " + n + "\\n")
lines = [json.dumps({"name": n.capitalize(), "matchType": "NoMatch", "results": []}) for n in reversed(names)]
print("a line that is no answer")
%s
print("\\n".join(lines))
"""


def program(tmp_path, twist=""):
    path = tmp_path / "verify"
    path.write_text(PROGRAM % twist)
    path.chmod(0o755)
    return str(path)


TERMS = ["homo sapiens", "Canis lupus", "canis Lupus", "felis"]


def test_answers_are_found_by_name(spark, tmp_path):
    from cladeworks.sources import verifier

    asked = spark.createDataFrame([(n, s) for n in TERMS for s in (11, 1)], "term string, source_id int")
    rows = verifier.program_responses(asked, program(tmp_path), 2, jobs=3).collect()
    assert sorted((r.term, r.source_id) for r in rows) == sorted((n, s) for n in TERMS for s in (11, 1)) and all(r.response.matchType == "NoMatch" for r in rows)
    (tmp_path / "lines.json").write_text("\n".join(json.dumps({"name": n, "matchType": "Exact", "results": []}) for n in ("a", "b")) + "\nnoise\n{}\n")
    assert sorted(r.term for r in verifier.json_responses(spark, str(tmp_path / "lines.json"), 11).collect()) == ["a", "b"]


@pytest.mark.parametrize("twist", ["lines = lines[1:]", "lines = lines[:-1]", "lines.append(lines[0])", "lines[0] = lines[1]", "lines[0] = lines[0].replace(\'{\"name\": \"\', \'{\"name\": \"x\')", "lines[0] = lines[0][:9]", "lines = []", "lines.append(\'{\"name\": \"more\"}\')"])
def test_incomplete_batches_are_never_no_match(spark, tmp_path, twist):
    from cladeworks.sources import verifier

    ask = program(tmp_path, f'if "felis" in names:\n    {twist}')
    asked = spark.createDataFrame([(n, 11) for n in TERMS], "term string, source_id int").coalesce(1)
    ledger = verifier.program_ledger(asked, ask, 2)
    ledger.write.parquet(str(tmp_path / "ledger"))
    ledger, kept = spark.read.parquet(str(tmp_path / "ledger")), []
    rows = {r.term: r for r in ledger.collect()}
    assert {t for t, r in rows.items() if r.complete} == {"homo sapiens", "Canis lupus"} and rows["felis"].tries == 3 and rows["felis"].sent == 2
    assert rows["homo sapiens"].tries == 1 and rows["homo sapiens"].received == 2
    with pytest.raises(verifier.IncompleteAnswers, match="1 batches with 2 names"):
        verifier.quarantine(ledger, lambda broken: kept.extend(broken.collect()))
    assert {r.term for r in kept} == {"felis", "canis Lupus"}
    with pytest.raises(Exception, match="answers to 2 names"):
        verifier.answers_of(ledger).collect()


def test_a_batch_is_sent_again(spark, tmp_path):
    from cladeworks.sources import verifier

    once = f'mark = "{tmp_path}/seen"\nif not os.path.exists(mark):\n    open(mark, "w").close()\n    lines = lines[1:]'
    asked = spark.createDataFrame([(n, 11) for n in TERMS], "term string, source_id int").coalesce(1)
    rows = verifier.program_ledger(asked, program(tmp_path, once), 10).collect()
    assert len(rows) == 4 and all(r.complete and r.tries == 2 and r.value for r in rows)


def test_stream_gives_the_rows_of_one_run(spark, tmp_path):
    from cladeworks.streaming.incremental import resolve_stream

    rows = [(str(i), None, *[None] * 6, f"Homo s{i % 3}") for i in range(12)]
    df = spark.createDataFrame(rows, ENTRY)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    answer = json.dumps({"name": "Homo s1", "matchType": "Exact", "results": [{"dataSourceId": 11, "matchedCanonicalSimple": "Homo s1", "taxonomicStatus": "Accepted", "matchType": "Exact", "classificationPath": "A|Homo s1", "classificationRanks": "kingdom|species"}]})
    table = spark.createDataFrame([("Homo s1", 11, answer)], "term string, source_id int, j string").select("term", "source_id", F.from_json("j", RESPONSE).alias("response"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = resolve_stream(source, table, str(tmp_path / "out"), str(tmp_path / "marks"))
    query.processAllAvailable()
    query.stop()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(str, got.collect())) == sorted(map(str, resolve.resolve(df, table).collect()))


def test_metadata_becomes_columns(spark):
    rows = spark.createDataFrame([("1", {"a": "x", "b": "y"}), ("2", {})], "uuid string, metadata map<string,string>")
    assert [tuple(r) for r in resolve.expand_metadata(rows, ["a", "c"]).orderBy("uuid").collect()] == [("1", "x", None), ("2", None, None)]


def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def matched(term, names):
    """(how, [(edits, name)]) over different names, each standing for all its rows."""
    if term in names:
        return "Exact", [(0, term)]
    near = [(d, c) for c in names if (d := edits_between(term, c)) <= 2]
    if near:
        return "Fuzzy", near
    genus = term.split(" ")[0]
    return ("PartialExact", [(0, genus)]) if genus != term and genus in names else None


def test_local_matcher_against_brute_force(spark):
    from cladeworks.sources.verifier import match_locally

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 9)))
    names = ["Canis lupus", "Canis", "Felis", "Quercus alba", "Quercus", *[word() for _ in range(60)], *[f"{word()} {word()}" for _ in range(60)]]
    taxa = [(11, f"t{i}", c, rng.choice(["accepted", "synonym"]), f"G{i % 7}") for i, c in enumerate([*names, *rng.choices(names, k=80)])]
    terms = {"anis lupus", "Xanis lupus", "Cnais lupus", "aCanis lupus", "elis", "Quercus rubra", "Canis lupusxx", "Canis lupusxxx", "Zzzzzzzzz yyy", *[word() for _ in range(80)], *[f"{word()} {word()}" for _ in range(80)], *names[:9]}
    df = spark.createDataFrame(taxa, "source_id int, taxonID string, canonicalName string, taxonomicStatus string, genus string")
    asked = spark.createDataFrame([(t, 11) for t in sorted(terms)], "term string, source_id int")
    got = {r.term: (r.response.matchType, sorted((x.editDistance, x.recordId, x.matchType) for x in r.response.results)) for r in match_locally(asked, df).collect()}
    expected = {}
    for t in terms:
        if (found := matched(t, set(names))) is not None:
            expected[t] = found[0], sorted((d, x[1], found[0]) for d, c in found[1] for x in taxa if x[2] == c)
    assert got == expected
    assert {"Exact", "Fuzzy", "PartialExact"} == {how for how, _ in got.values()} and got["anis lupus"][0] == "Fuzzy"


def test_local_matcher_query_sees_every_taxon(spark):
    from cladeworks.plans import catalog, driver_views

    sf = "/root/testdata/sf0.001"
    rows = Counter(r.canonicalName for r in driver_views.taxa(spark, sf).collect())
    terms = {r.term for r in ladder.lookups(catalog._groups(spark, sf)).filter("source_id = 11").collect()}
    expected = {t: (found[0], sum(rows[c] for _, c in found[1])) for t in terms if (found := matched(t, rows)) is not None}
    assert {r.term: (r.matchType, r.n) for r in catalog.local_matcher(spark, sf).collect()} == expected


def test_vernacular_queries_read_whole_texts(spark, tmp_path):
    from cladeworks.plans import catalog

    texts = [(400, "fr", "un nom assez long pour la coupe o'brien-x"), (800, "en", "THE LONG name of a beast\nwith 2nd line, past-any prefix ÉTÉ"), (1200, "en", "later one"), (401, "de", "ein " * 3000 + "ende"), (402, None, "no language")]
    spark.createDataFrame([(i, t, k) for i, k, t in texts], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))

    def title(text):
        return "".join(c.upper() if i == 0 or not text[i - 1].isalnum() else c for i, c in enumerate(text)) if (text := text.lower()) else text

    expected = {"0": title(texts[1][2]), "1": title(texts[3][2])}
    assert {r.taxonID: r.vernacularName for r in catalog.prioritize_vernacular(spark, str(tmp_path)).collect()} == expected
    sf = "/root/testdata/sf0.001"
    best = {}
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").filter("lang is not null").collect(), key=lambda r: (r.lang != "en", r.doc_id)):
        best.setdefault(str(r.doc_id % 400), r.text)
    whole = {r.taxonID: r.vernacularName for r in catalog.prioritize_vernacular(spark, sf).collect()}
    assert whole == {k: title(v) for k, v in best.items()}
    for query in (catalog.common_names_on, catalog.common_names_off):
        assert {r.common_name for r in query(spark, sf).collect() if r.common_name} <= set(whole.values())


def test_trace_gives_first_members_of_each_group(spark):
    from cladeworks.operators.trace import trace_entry

    rows = [(u, f"Homo s{g}", *[None] * 7) for g in range(3) for u in ("x", *[f"{g}{k}" for k in range(5)])]
    df = spark.createDataFrame(rows, ENTRY)
    tried = spark.createDataFrame([], "group_key string, rung int, query_term string, query_rank string, source_id int, status string, strategy string, failure_reason string, error string")
    got = [json.loads(r.trace)["group"] for r in trace_entry(df, lambda groups: tried, "x").collect()]
    assert sorted(g["first_members"] for g in got) == [[f"{g}{k}" for k in range(3)] for g in range(3)]


def test_trace_holds_entry_plan_and_every_attempt(spark):
    from cladeworks.operators.trace import as_text, group_members, trace_entry

    rows = [(u, None, "Animalia", *[None] * 4, "Homo", "Homo sapiens") for u in ("b", "a")] + [("c", None, "Animalia", *[None] * 6)]
    df = spark.createDataFrame(rows, ENTRY)
    nothing = spark.createDataFrame([], "term string, source_id int").withColumn("response", F.lit(None).cast(RESPONSE))
    said = trace_entry(df, lambda groups: resolve.chains(resolve.final_attempts(groups, nothing)), "b").collect()
    body = json.loads(said[0].trace)
    assert len(said) == 1 and body["entry"]["uuid"] == "b" and body["entry"]["most_specific_rank"] == "species"
    assert body["group"]["first_members"] == ["a", "b"] and body["group"]["group_count"] == 2
    assert body["query_plan"] == {"query_term": "Homo sapiens", "query_rank": "species", "source_id": 11}
    terms = [("Homo sapiens", "species"), ("Homo", "genus"), ("Animalia", "kingdom")]
    assert [(x["rung"], x["query_term"], x["query_rank"], x["source_id"]) for x in body["attempts"]] == [(3 * k + j, *t, s) for k, t in enumerate(terms) for j, s in enumerate((11, 1, 179))]
    assert [x["status"] for x in body["attempts"]] == ["RETRY_SCHEDULED"] * 8 + ["NO_MATCH_RETRIES_EXHAUSTED"]
    assert as_text(said[0].trace).count("\nAttempt ") == 9
    assert [r.uuid for r in group_members(df, "b").collect()] == ["a", "b"]
    assert trace_entry(df, lambda groups: resolve.chains(resolve.final_attempts(groups, nothing)), "absent").count() == 0



def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_few_answers_do_not_move_the_rungs(spark):
    """Few terms are asked for by very many groups: their answers go to the rungs, and a query of statuses builds no other outcome."""
    from cladeworks.plans import catalog

    plan = _plan(catalog.resolve_attempts(spark, "/root/testdata/sf0.001"))
    assert "strategy=broadcast" in plan and "Aggregate" not in plan and "failure_reason" not in plan


def test_answers_that_decide_alone(spark, monkeypatch):
    """``settled`` gives what the rules give when they run."""
    from cladeworks.operators import cascade
    from cladeworks.plans import driver_views as V

    groups = grouping.group_entries(V.entries(spark, "/root/testdata/sf0.001").filter("uuid % 10 = 0"))
    said = V.responses(ladder.lookups(groups))
    alone = cascade.prepared(said).groupBy(F.col("settled").isNotNull()).count().collect()
    assert len(alone) == 2
    seen = ["group_key", "rung", "rule", "status", "strategy", "resolved", "failure_reason", "error", F.to_json("metadata")]
    rows = lambda: sorted(map(str, resolve.attempts(groups, said).select(*seen).collect()))
    got = rows()
    monkeypatch.setattr(cascade, "_SETTLED", "cast(null as int)")
    assert got == rows() and len(got) > 1000


def test_attempt_keys_need_no_rules(spark):
    from cladeworks.plans import catalog

    assert "inline" not in _plan(catalog.attempt_keys(spark, "/root/testdata/sf0.001"))
