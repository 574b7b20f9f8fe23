"""Filter audit, cross-tokenizer alignment and licence scans against brute force."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cladeworks.llm import filter_audit, license_scan, pair_table, queries, token_align
from cladeworks.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.01"
A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
KIND = "doc_id long, text string, lang string, extra string, part string, digest string, mask int, n long, good int, key string, words string, _key string"
ODD = [
    "", None, " \n\t", "one", "a b c d e", "x" * 5000, "é è ê " * 50, " nbsp wide 　x", "▁lower ▁bar", "emoji 😀 zwj 👩‍🚀", "trailing   ", "\n", "a\u0085b  c",
    "</s>[INST] ok [/INST] <s> <unk> <|endoftext|>", "word " * 3000, "ﬁ ligature ① half", "<0x41> \x00 nul", "  two  leading", "A" * 40 + " $", "under the MIT License, under  the\nmit-license", "one",
]


def table(spark, rows):
    """Rows ``(doc_id, text, lang)`` with extra columns of names that the operators use."""
    return spark.createDataFrame([(*r, *["x"] * 3, 7, 7, 7, *["x"] * 3) for r in rows], KIND)


def odd(spark):
    rows = [(i, t, ["en", "", None, "de"][i % 4]) for i, t in enumerate(ODD)]
    rows += [(None, "one", "en"), (None, None, None), (3, ODD[3], "fr"), (3, ODD[3], "en"), (400, "one", "en"), (-5, "late but first", "de"), (401, "late but first", "de")]
    return table(spark, rows)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def failed(rows):
    """Part, failed filters and identifier of each row."""
    out = []
    for d, t, lang in rows:
        t, w = t or "", words(t)
        e = any(y == t and x is not None and d is not None and x < d for x, y in ((x, y or "") for x, y, _ in rows))
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), e]
        out.append((lang or "", {"ABCDE"[k] for k in range(5) if fails[k]}, d))
    return out


def audited(rows, labels):
    """The report by applying every order to every row."""
    docs, out = failed(rows), {}
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    orders = ["".join(o) for o in permutations("ABCDE")]
    for part in {p for p, _, _ in docs}:
        mine = [(f, d) for p, f, d in docs if p == part]
        shapley = Counter()
        for order in orders:
            left = list(mine)
            for step, x in enumerate(order, 1):
                lost = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                shapley[x] += len(lost)
                out[part, order, step] = [
                    len(left), len(lost), sum(x in f for f, _ in mine) - len(lost), sum(f == {x} for f, _ in mine), sum(d in good for _, d in lost), sum(d in toxic for _, d in lost)
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def check_audit(docs, rows, marks, labels):
    got = filter_audit.audit(docs, marks).collect()
    assert len(got) == len({r.part for r in got}) * 600
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in got} == audited(rows, labels)


LABELS = "doc_id long, quality int, toxic int"


def test_audit_on_odd_rows(spark):
    docs = odd(spark)
    labels = [(3, 1, 0), (3, 0, 1), (5, 1, 0), (14, 0, 1), (18, 1, 1), (400, 1, None), (None, 1, 1), (999, 1, 1)]
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    check_audit(docs, rows, spark.createDataFrame(labels, LABELS), labels)
    check_audit(docs.repartition(5), rows, spark.createDataFrame([], LABELS), [])
    assert filter_audit.audit(docs.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0


def test_audit_on_documents_and_hot_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").filter("doc_id < 200")
    rows = [tuple(r) for r in docs.collect()] + [(1000 + i, "the same text", ["en", "de"][i % 2]) for i in range(150)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 1150, 3)]
    labels = [(d, q, int(t)) for d, q, t in labels]
    check_audit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), rows, spark.createDataFrame(labels, LABELS), labels)


def test_audit_equals_its_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    sql = con.sql(queries.OP11_SQL)
    got = queries.op11_filter_audit(spark, SF)
    assert sorted(got.columns) == sorted(sql.columns)
    assert sorted(map(tuple, got.select(*sql.columns).collect())) == sorted(sql.fetchall())


def test_gray_code_walk_visits_every_state():
    rng = random.Random(2)
    cells = {m: (rng.randrange(9), rng.randrange(5), rng.randrange(3)) for m in rng.sample(range(32), 20)}
    for state, got in enumerate(filter_audit.walk(cells)):
        assert got == tuple(sum(x[k] for m, x in cells.items() if not m & state) for k in range(3))
    assert filter_audit.walk({})[31] == (0, 0, 0)


class Plain:
    """Both tokenizers, whole texts, with the libraries alone."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.back = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}

    def tokens(self, text):
        """(id, bytes) of both sides; nothing if they do not spell the text."""
        if not text:
            return [], []
        a = [(i, bytes(self.back[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])

    def aligned(self, text):
        a, b = self.tokens(text)
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e] if len(a) < 400 else self._links(*spans)
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, last = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in side if last <= s and e <= end) for side in spans) if len(a) < 400 else None)
            last = end
        return len(a), len(b), len(ends), links, ";".join(groups) if None not in groups else None

    @staticmethod
    def _links(a, b):
        out, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            out.append((a[i][0], b[j][0]))
            ea, eb = a[i][2], b[j][2]
            i, j = i + (ea <= eb), j + (eb <= ea)
        return out


def check_alignment(docs, **options):
    plain = Plain()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    said = [plain.aligned(t) for _, t in rows]
    counts = Counter(pair for *_, links, _ in said for pair in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    expected, seen = Counter(), Counter()
    for (d, _), (n_a, n_b, n_groups, links, text) in zip(rows, said, strict=True):
        digest = None if text is None else hashlib.sha256(text.encode()).hexdigest() if links else ""
        expected[d, n_a, n_b, n_groups, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest] += 1
    unknown = {k[:-1] for k in expected if k[-1] is None}
    for r in token_align.report(docs, A, B, **options).collect():
        seen[(*r[:-1], None) if tuple(r[:-1]) in unknown else tuple(r)] += 1
    assert seen == expected


@pytest.mark.parametrize("options", [{}, {"table_bytes": 0}, {"shard_bits": 0}])
def test_alignment_on_odd_rows(spark, options):
    check_alignment(odd(spark).repartition(3), **options)


def test_alignment_on_documents(spark, monkeypatch):
    monkeypatch.setattr(token_align, "FAN", 2)
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 300 and length(text) < 4000").repartition(9)
    check_alignment(docs)
    monkeypatch.setattr(token_align, "ASKED_BYTES", 1 << 10)
    check_alignment(docs, table_bytes=0, shard_bits=2)


def test_alignment_of_an_empty_table(spark):
    for bound in (0, 1 << 20):
        assert token_align.report(odd(spark).limit(0), A, B, table_bytes=bound).count() == 0


def test_alignment_lists_groups(spark):
    plain = Plain()
    docs = odd(spark)
    want = Counter((r.doc_id, plain.aligned(r.text)[4]) for r in docs.collect() if r.text and len(r.text) < 400)
    got = Counter()
    for r in token_align.align(docs, A, B).collect():
        cut = lambda ids, ends: [",".join(map(str, ids[s:e])) for s, e in zip([0, *ends], ends, strict=False)]
        got[r.doc_id, ";".join(f"{x}|{y}" for x, y in zip(cut(r.a_ids, r.group_a), cut(r.b_ids, r.group_b), strict=True))] += 1
    assert want <= got


def test_pair_counts_are_the_links(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60 and length(text) < 3000")
    plain = Plain()
    counts = Counter(pair for r in docs.collect() for pair in plain.aligned(r.text)[3])
    table = token_align.pair_table(docs, A, B)
    assert {(r.a_id, r.b_id): r.links for r in token_align.pair_counts(table, plain.b.get_piece_size()).collect()} == counts


def test_minimal_perfect_hash():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        bits, sizes = pair_table.pack(pair_table.build(keys))
        place = pair_table.Hash([(bits, sizes)], 0).index(keys)
        assert sorted(place.tolist()) == list(range(len(keys)))
        ordered = np.empty_like(keys)
        ordered[place] = keys
        table = pair_table.PairTable([(bits, sizes, ordered.tobytes(), np.arange(len(keys)).astype("<i8").tobytes())], 0)
        assert (table.count(keys) == place).all()
        foreign = np.setdiff1d(rng.integers(0, 1 << 62, 2000, dtype=np.uint64), keys)
        assert not table.count(foreign).any()


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def scanned(text, rules):
    """Every rule over the whole text, and every match held against every other one."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    joined = " " + " ".join(w) + " "
    base = sorted((i, label) for phrase, label in license_scan.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    found = []
    for k, r in enumerate(rules):
        for m in re.finditer(f" (?:{r.pattern})(?= )", joined):
            found.append((k, joined[: m.start()].count(" "), joined[: m.end()].count(" ")))
    kept = []
    for k, s, e in found:
        inside = [x for x in found if x != (k, s, e) and x[1] <= s and e <= x[2] and rules[x[0]].priority >= rules[k].priority]
        # An equal interval of equal priority only counts if its rule comes first.
        if not any((x[1], x[2]) != (s, e) or rules[x[0]].priority > rules[k].priority or x[0] < k for x in inside):
            kept.append((rules[k].label, rules[k].name, rules[k].priority, s, e))
    sure = {label: license_scan.BASE_CONFIDENCE for _, label in base}
    for label, name, *_ in kept:
        sure[label] = max(sure.get(label, 0), next(r.confidence for r in rules if r.name == name))
    return len(w), base, sorted(kept), 1 - np.prod([1 - x for x in sure.values()]) if sure else 0.0


LICENSED = [
    "Licensed under the Apache License, Version 2.0.", "Released under the MIT License. And again: UNDER THE MIT LICENSE", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC-SA 4.0 (see cc by)",
    "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-2.0-or-later", "GNU Lesser General Public License v2.1 and GNU General Public License",
    "sous licence MIT, bajo licencia Apache 2.0, unter der BSD Lizenz", "All rights reserved. No part", "All Rights Reserved", "ein Haus mit Garten", "MIT", "license: MIT", "MPL 2.0 licensed",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")", "mit license " * 40, "cc by nc cc by nc cc by nc nd",
    "neither the name of the University nor the names of its contributors may be used to endorse or promote products", "Boost Software License - Version 1.0", "the unlicensé", "x11 licence, zlib licence",
]


def test_licences_against_brute_force(spark):
    rules = license_scan.default_rules()
    assert len(rules) > 300
    docs = table(spark, [(i, t, "en") for i, t in enumerate(LICENSED)]).unionByName(odd(spark)).unionByName(table(spark, [(None, LICENSED[0], None), (5, LICENSED[0], None)]))
    texts = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 80").select("doc_id", "text")
    docs = docs.select("doc_id", "text", "key").unionByName(texts.withColumn("key", F.lit("x")))
    want = Counter()
    for r in docs.collect():
        n, base, kept, score = scanned(r.text, rules)
        want[r.doc_id, n, tuple(base), tuple(kept), round(float(score), 9)] += 1
    got = Counter()
    for r in license_scan.detect(docs).collect():
        got[r.doc_id, r.n_words, tuple((x.first_word, x.label) for x in r.phrases), tuple(sorted(tuple(x) for x in r.matches)), round(r.score, 9)] += 1
    assert got == want
    assert license_scan.detect(docs.limit(0)).count() == 0


def test_every_match_of_a_rule_holds_a_keyword():
    """Each alternative of a rule is spelled out, so that a keyword which a match can lack is seen."""
    for r in license_scan.default_rules():
        for text in spelled(r.pattern):
            assert re.fullmatch(r.pattern, text), (r.name, text)
            assert set(text.split()) & set(r.keywords), (r.name, text)


def spelled(pattern, most=400):
    """Texts that a pattern matches: every alternative and option of its parsed form, up to ``most``."""
    from re import _constants as c
    from re import _parser

    def of(tree):
        texts = [""]
        for op, arg in tree:
            if op is c.LITERAL:
                more = [chr(arg)]
            elif op is c.IN:
                more = ["q"] if arg[0][0] is c.NEGATE else [chr(a) for o, a in arg if o is c.LITERAL][:2]
            elif op is c.NOT_LITERAL:
                more = ["q"]
            elif op is c.BRANCH:
                more = [t for branch in arg[1] for t in of(branch)]
            elif op is c.SUBPATTERN:
                more = of(arg[3])
            else:
                low, high, body = arg
                more = [t * k for k in sorted({low, max(1, low)}) for t in of(body)]
            texts = [a + b for a in texts for b in more][: most * 4]
        return texts

    out = of(_parser.parse(pattern))
    return random.Random(1).sample(out, min(most, len(out)))


def test_licence_query_columns(spark):
    r = {x.doc_id: x for x in license_scan.summary(license_scan.detect(table(spark, [(i, t, "en") for i, t in enumerate(LICENSED)]))).collect()}
    assert (r[0].n_base, r[0].first_word, r[0].last_word, r[0].base_labels, r[0].labels) == (1, 3, 3, "apache-2", "apache-2")
    assert (r[1].n_base, r[1].first_word, r[1].last_word) == (2, 1, 7)
    assert r[3].base_labels == "cc-by-nc" and r[3].labels == "cc-by-nc,cc-by-nc-sa"
    assert r[4].labels == "gpl-3" and r[5].labels == "gpl-2" and r[6].labels == "gpl,lgpl-2.1"
    assert (r[10].n_base, r[10].first_word, r[10].labels, r[10].score) == (0, None, "", 0.0)
    assert r[7].labels == "apache-2,bsd,mit" and r[11].labels == ""


def test_licences_in_long_texts(spark):
    text = "mit license and apache license version 2 0 " * 60_000
    r = license_scan.summary(license_scan.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.labels) == (480_000, 60_000, 3, 479_995, "apache-2,mit")


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_token_alignment", "op13_license_scan"])
def test_queries_return_the_contract(spark, name):
    columns = {
        "op11_filter_audit": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
        "op12_token_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
        "op13_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    }[name]
    got = queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert ", ".join(f"{c} {t}" for c, t in got.dtypes).startswith(columns)
    assert got.count() > 0


def test_arrow_columns_of_long_strings():
    n, places, found = license_scan.Scanner(license_scan.default_rules()).scan(pa.array(["mit license"]).to_pylist()[0].encode())
    assert n == 2 and not places and len(found) == 1
