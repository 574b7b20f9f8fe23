"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from cladeworks.llm import byte_bpe, chat_format, exact_dedup, language_id, mixing, ngram_join, quality_rules, queries, sentence_pieces, token_planes, url_filter, warc
from cladeworks.llm.queries import tokenizer_path
from cladeworks.llm.runtime import broadcast_if_small
from cladeworks.llm.words import shingle_sets, string_buffer

SF = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rep string, size string"
ODD = [
    "", " \n\t", "one", "two words", "a b c d e", "A B C D E", "x" * 5000, "é è ê " * 50, "\u00a0nbsp\u2003wide \u3000x", "don't we'll I'VE x.'s 's",
    "a  b   c\n\n\nd \n e", "tab\tand\r\nreturn", "<|endoftext|> inside <s> </s>", "12ab34 5.5,6", "\u2581lower \u2581bar", "emoji 😀 zwj 👩\u200d🚀", "trailing   ", "\n", "a\u0085b \u1680c",
    "</s>[INST] ok [/INST]", "back\\slash \\\\ <|turn|>", "word " * 3000, "0 0 0 0 0 0", "ﬁ ligature ① half",
]


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else "s", 1, "r", "z") for i, t in enumerate(ODD)]
    rows += [(100, None, None, None, None, None, None), (None, "no id", "en", "s", 1, "r", "z"), (3, ODD[3], "en", "s", 1, "r", "z"), (101, "one", "en", "s", 1, "r", "z")]
    return spark.createDataFrame(rows, DOCS)


def shingles(text):
    words = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(rows):
    """doc_id: (set size, component) by comparing all pairs."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    items = sorted((len(s), d) for d, s in sets.items() if s)
    for i, (n, a) in enumerate(items):
        for m, b in items[i + 1 :]:
            if 100 * n < 75 * m:
                break
            common = len(sets[a] & sets[b])
            if 100 * common >= 75 * (n + m - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def check_components(df):
    rows = [(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()}
    got.pop(None, None)
    assert got == components(rows)


def test_shingles_match_words():
    texts = [*ODD, None]
    for t, s in zip(texts, shingle_sets(pa.array(texts)), strict=True):
        assert len(s) == len(shingles(t))


def test_join_on_documents(spark):
    check_components(documents(spark))


def test_join_on_odd_rows(spark):
    check_components(odd(spark))
    assert ngram_join.jaccard_components(odd(spark).limit(0)).count() == 0


def test_join_on_near_copies_and_small_sets(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(60)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    for i in range(400, 700):
        n = rng.randrange(1, 16)
        rows.append((i, " ".join(rng.choice("abc") for _ in range(n))))
    for i in range(700, 800):
        rows.append((i, " ".join([f"u{i}_{k}" for k in range(12)] + base[:40])))
    check_components(spark.createDataFrame(rows, "doc_id long, text string"))


def test_join_cuts_long_lists_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(40)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(40)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    check_components(spark.createDataFrame(rows, "doc_id long, text string"))


def test_join_deals_hot_lists_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_LIST", 40)
    rng = random.Random(6)
    base = [f"w{k}" for k in range(50)]
    rows = []
    for i in range(400):
        words = list(base[: rng.randrange(40, 51)])
        for _ in range(rng.randrange(1, 3)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base[:30] + [f"u{i}_{k}" for k in range(30)])) for i in range(150)]
    check_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_join_of_templates_keeps_subset_lists_short(spark, monkeypatch):
    """Sets of one template share subsets; from each task a list gets a set of each connected part, not all of them."""
    words = [f"w{k}" for k in range(12)]
    rows = [(i, " ".join([*words[:11], f"e{i}"])) for i in range(2000)]  # 7 of 8 shingles are the template's
    rows += [(5000 + i, " ".join([f"d{i}", *words[1:]])) for i in range(300)]
    rows += [(6000 + i, " ".join(words[:10])) for i in range(3)] + [(7000 + i, " ".join([*words[:10], "x", f"y{i}"])) for i in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert got == components(rows)
    entries, keys = [], set()
    for i, (s, t, k) in enumerate(ngram_join.subset_signatures(8)):
        entries += [(np.uint64(77 + i), key, 8 | int(ngram_join._SUBSET) | (int(ngram_join._SAME) if s == t else 0)) for key in range(1, 1001)]
    token, key, size = (np.array(x, d) for x, d in zip(zip(*entries, strict=True), (np.uint64, np.int64, np.uint32), strict=True))
    t, k, _ = ngram_join._collapsed(token, key, size)
    lists = defaultdict(set)
    for a, b in zip(t.tolist(), k.tolist(), strict=True):
        lists[a].add(b)
        keys.add(b)
    assert keys == set(range(1, 1001)) and all(len(v) <= 2 for v in lists.values())


def test_token_files_of_one_identifier(spark, tmp_path):
    """Rows of one identifier spread over files, in one order whatever order they come in."""
    rows = [(None if i % 2 else 7, f"text number {i % 90} " * 30) for i in range(400)]
    read = lambda parts: sorted(map(tuple, token_planes.read_tokens(token_planes.write_tokens(spark.createDataFrame(rows if parts > 1 else rows[::-1], "doc_id long, text string").repartition(parts), tokenizer_path("byte_bpe_50k.json"))).collect()), key=str)
    first = read(3)
    assert first == read(1) and len(first) == 400
    manifest = token_planes.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path("byte_bpe_50k.json"))
    assert manifest.count() > 2


def test_subset_signatures_are_links():
    for n in range(1, 13):
        for s, t, k in ngram_join.subset_signatures(n):
            assert n in (s, t) and k <= s <= t and 100 * k >= 75 * (s + t - k)
    assert ngram_join.boundary({4: 10, 8: 10, 100: 10}, 4.0) >= 4


def conversation_rows(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn if turn is not None else -(10**9), role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        whole = "".join(chat_format.format_turn(r, t) for _, r, t in turns)
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole))
    return out


@pytest.mark.parametrize("limits", [(1 << 18, 4096), (500, 3)])
def test_chat_round_trip(spark, limits):
    table = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = [*queries.ADDED, (-1, None, None, None), (-2, 0, "user", "same"), (-3, 0, "user", "same"), (-3, 1, "assistant", ""), (-4, 0, "assistant", "<|end|>\\"), (-4, 0, "assistant", "<|end|>\\"), (-5, 1, "assistant", "a"), (-5, 0, "user", "same")]
    df = table.unionByName(spark.createDataFrame(more, "conv_id long, turn long, role string, text string"))
    packs = chat_format.pack(df, *limits)
    got = {r.conv_id: tuple(r)[1:] for r in chat_format.read_packs(packs).collect()}
    assert got == conversation_rows([tuple(r) for r in df.collect()])
    for p in packs.collect():
        for n in p.nodes:
            assert n.position == sum(x.stop - x.start for x in n.attends) - n.length
            assert n.attends[-1].stop == n.start + n.length
    assert chat_format.read_packs(chat_format.pack(df.limit(0))).count() == 0


def test_shared_turns_are_emitted_once(spark):
    rows = [(c, 0, "user", "shared question") for c in range(50)] + [(c, 1, "assistant", f"answer {c % 5}") for c in range(50)]
    packs = chat_format.pack(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)).collect()
    assert sum(len(p.nodes) for p in packs) <= 6 + 2 * len(packs)
    assert sum(len(p.conversations) for p in packs) == 50


def test_escape_is_reversible_and_hides_control():
    rng = random.Random(1)
    parts = [*chat_format.CONTROL, "\\", "<", "|", "[", "]", "/", "INST", "s>", "turn|>", "a"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
        e = chat_format.escape(t)
        assert chat_format.unescape(e) == t and not any(c in e for c in chat_format.CONTROL)


def naive_rule(url, rules=url_filter.RULES, blocked=url_filter.BLOCKED_HOSTS):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    under = lambda h: host == h or host.endswith("." + h)
    fits = [(len(r), r, v) for r, v in rules if under(r.partition("/")[0]) and path.startswith("/" + r.partition("/")[2])]
    if fits:
        return host, path, *max(fits)[1:]
    return host, path, None, "block" if any(under(b.rstrip("/")) for b in blocked) else "allow"


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://ORG", "http://org/", "https://a.b.example.ORG/es/x?q#f", "http://example.org/en/1", "http://example.org/en/12", "x://y://org/z", "http://com/de/\n", "http://notexample.org/es/", "http://www.spam-farm.example.org", "http://free-bets.example.net?x", "http://x.com/fr/é#"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumnsRenamed({})
    df = df.unionByName(spark.read.parquet(f"{SF}/pages.parquet").selectExpr("page_id + 1000 as page_id", "url"))
    for r in url_filter.judge_urls(df).collect():
        assert (r.host, r.path, r.rule, r.verdict) == naive_rule(r.url), r.url
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_block_list_covers_its_sites_under_every_suffix(spark):
    names = ("ads-track", "casino-win", "spam-farm", "adult-x", "cheap-pills", "free-bets")
    bad = [f"http://{sub}{name}.example.{top}{end}" for name in names for top in ("com", "net", "org") for sub in ("", "www.", "m.", "blog.") for end in ("", "?q")]
    fine = ["http://notspam-farm.example.net", "http://spam-farm.example.net.other.test/", "http://example.com/", "http://farm.example.org"]
    df = spark.createDataFrame([(u,) for u in bad + fine], "url string")
    got = {r.url: (r.rule, r.verdict) for r in url_filter.judge_urls(df).collect()}
    assert {got[u] for u in bad} == {(None, "block")}
    assert {got[u][1] for u in fine} == {"allow"}
    pages = url_filter.judge_urls(spark.read.parquet(f"{SF}/pages.parquet").select("url")).filter("rule is null").collect()
    on_sites = [r.verdict for r in pages if any(re.search(rf"(^|\.){n}\.", r.host) for n in names)]
    assert on_sites and set(on_sites) == {"block"}


def test_block_lists_are_inputs(spark, tmp_path):
    (tmp_path / "hosts.txt").write_text("# sites\nbad.test\n\n evil.test \n")
    hosts = url_filter.block_list(spark, str(tmp_path / "hosts.txt"))
    assert hosts == ("bad.test/", "evil.test/")
    urls = ["http://www.bad.test/x", "http://evil.test", "http://notevil.test/", "http://spam-farm.example.com/"]
    got = url_filter.judge_urls(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), blocked=hosts).orderBy("page_id").collect()
    assert [r.verdict for r in got] == ["block", "block", "allow", "allow"]
    with pytest.raises(ValueError, match="4 lines"):
        url_filter.block_list(spark, str(tmp_path / "hosts.txt"), 3)


def test_long_hosts_and_paths(spark):
    """A URL has as many probe keys as there are lengths of rules, however long it is."""
    deep = "a." * 200_000
    urls = [f"http://{deep}example.org/es/x", f"http://{deep}com/" + "p/" * 100_000, "http://" + "x" * 500_000 + "/fr/", f"http://{deep[:-1]}/", "http://org/"]
    got = url_filter.judge_urls(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")).orderBy("page_id").collect()
    assert [r.rule for r in got] == ["example.org/es/", None, None, None, "org/"] and [r.verdict for r in got] == ["block", "allow", "allow", "allow", "allow"]
    assert [len(r.host) for r in got][0] == len(deep) + len("example.org")


def test_digest_collisions_are_confirmed(tmp_path, monkeypatch):
    import xxhash

    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda b: len(b))
    index = url_filter.DigestIndex(url_filter.write_index(str(tmp_path / "i"), [("aa/", "allow"), ("bb/", "block"), ("cc/", "allow")]))
    assert index.find([b"aa/", b"bb/", b"cc/", b"dd/"]) == ["allow", "block", "allow", None]


def test_full_chunk_tables_keep_what_is_at_hand():
    from cladeworks.llm.chunks import ChunkTable

    asked, rng = [], random.Random(8)
    table = ChunkTable(lambda keys: asked.extend(keys) or [[k[0], len(k), 70_000 if k[0] == 122 else 1] for k in keys], most=50)
    for _ in range(60):
        chunks = [bytes([rng.randrange(97, 123)] * rng.randrange(1, 5)) for _ in range(30)]
        raw, stops = np.frombuffer(b"".join(chunks), np.uint8), np.cumsum([len(c) for c in chunks])
        ids, counts = table.ids(raw, stops - [len(c) for c in chunks], stops)
        assert ids.tolist() == [x for c in chunks for x in (c[0], len(c), 70_000 if c[0] == 122 else 1)] and set(counts.tolist()) == {3}
        assert len(table.slots) <= 50 + 30
    assert len(asked) < 60 * 30


def test_byte_bpe_matches_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library, model = Tokenizer.from_file(path), byte_bpe.ByteBpe(path)
    assert model.by_chunk
    rng = random.Random(2)
    alphabet = ["a", "Zé", " ", "  ", "\n", "\t", "\r\n", "'", "'s", "'LL", ".", "!?", "1", "23", "\u00a0", "\u2003", "\u3000", "\u0085", "中", "😀", "_", "\x00", "\x1f", "ß", "’"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(4000)]
    for group in (texts, [t for t in texts if "<|endoftext|>" not in t]):
        raw, offsets = string_buffer(pa.array(group))
        for i, ids, bounds in model.encode(raw, offsets):
            for k in range(len(bounds) - 1):
                assert ids[bounds[k] : bounds[k + 1]].tolist() == library.encode(group[i + k], add_special_tokens=False).ids, repr(group[i + k])


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(tmp_path, kind):
    rng = np.random.default_rng(0)
    lengths = np.array([0, 1, 700, 3, 0, 2000])
    ids = rng.integers(0, 70_000, lengths.sum()).astype(np.uint32)
    writer = token_planes.PlaneWriter(str(tmp_path / "x"), kind, block=256)
    writer.add(np.arange(3), lengths[:3], ids[: lengths[:3].sum()])
    writer.add(np.arange(3, 6), lengths[3:], ids[lengths[:3].sum() :])
    writer.close()
    reader = token_planes.PlaneReader(str(tmp_path / "x"))
    assert np.array_equal(reader.read(0, len(ids)), ids) and np.array_equal(reader.read(250, 1030), ids[250:1030])
    at = 0
    for (doc, start, got), n in zip(reader.documents(), lengths.tolist(), strict=True):
        assert start == at and np.array_equal(got, ids[at : at + n])
        at += n
    for width in (1, 13, 65536):
        x = rng.integers(0, 2**32, width, dtype=np.uint64).astype(np.uint32)
        assert np.array_equal(token_planes.from_planes(token_planes.to_planes(x, kind), width, kind), x)


@pytest.mark.parametrize("table", [documents, odd])
def test_token_files(spark, table):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    df = table(spark)
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    expected, start = [], 0
    for d, t in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_planes.read_tokens(token_planes.write_tokens(df, tokenizer_path("byte_bpe_50k.json"))).collect()
    assert sorted(map(str, expected)) == sorted(str(tuple(r)) for r in got)
    assert token_planes.read_tokens(token_planes.write_tokens(df.limit(0), tokenizer_path("byte_bpe_50k.json"))).count() == 0


def naive_measures(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    dup = len(lines) - len(set(lines))
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words)


def naive_votes(text):
    """A vote for each rule, from its definition."""
    text = text or ""
    n, chars, symbols, dup, repeat, _ = naive_measures(text)
    lines = sum(1 for x in text.split("\n") if WORDS.search(x))
    letters = len(regex.findall(r"\p{L}", text))
    word = regex.compile(r"""["'(\[«“‘¿¡]?\p{L}[\p{L}\p{M}'’-]*[.,;:!?"')\]»”’…]*""")
    plain = sum(bool(word.fullmatch(w)) for w in WORDS.findall(text))
    ratio = lambda a, b: a / b if b else None
    measured = [
        (ratio(chars, n), lambda m: 3 <= m <= 12, lambda m: m < 2 or m > 20), (ratio(symbols, n), lambda m: m <= 0.05, lambda m: m > 0.1),
        (ratio(symbols, chars), lambda m: m <= 0.01, lambda m: m > 0.05), (ratio(dup, lines), lambda m: m <= 0.05, lambda m: m > 0.3),
        (ratio(repeat, n), lambda m: m <= 0.05, lambda m: m > 0.2), (ratio(letters, chars), lambda m: m >= 0.8, lambda m: m < 0.65),
        (ratio(plain, n), lambda m: m >= 0.9, lambda m: m < 0.7), (n, lambda m: m >= 50, lambda m: m < 10),
    ]
    return tuple(0 if m is None else -1 if bad(m) else 1 if good(m) else 0 for m, good, bad in measured)


def naive_posterior(votes):
    """Expectation-maximisation document by document."""
    votes = np.array(votes)
    good = np.where((votes < 0).any(axis=1), 0.1, 0.9)
    for _ in range(40):
        share = (good.sum() + 1) / (len(votes) + 2)
        odds = np.full(len(votes), np.log(share / (1 - share)))
        for v in votes.T:
            rate = [(1 + w[v > 0].sum()) / (2 + w[v != 0].sum()) for w in (good, 1 - good)]
            odds += np.where(v > 0, np.log(rate[0] / rate[1]), np.where(v < 0, np.log((1 - rate[0]) / (1 - rate[1])), 0))
        good = 1 / (1 + np.exp(-odds))
    return good


@pytest.mark.parametrize("table", [documents, odd])
def test_quality_against_brute_force(spark, table):
    df = table(spark)
    texts = defaultdict(list)
    rows = df.collect()
    for r, p in zip(rows, naive_posterior([naive_votes(r.text) for r in rows]), strict=True):
        m = naive_measures(r.text)
        texts[r.doc_id].append((m, p, not m[5] and p >= 0.5))
    rows = quality_rules.judge(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        own = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert any(own == m and abs(r.probability - p) < 1e-6 and r.kept == kept for m, p, kept in texts[r.doc_id]), r
    assert quality_rules.judge(df.limit(0)).count() == 0
    if table is documents:
        # The posterior rejects texts that the base rules let pass, and not many.
        assert 20 < sum(not r.kept and not r.base_failed for r in rows) < 0.2 * len(rows)


def test_quality_keeps_clean_documents(spark):
    """Labels are looked at here only; what becomes of bad documents is reported in the README and asserted nowhere."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in quality_rules.judge(documents(spark)).select("doc_id", "kept", "base_failed").collect() if r.doc_id in labels and not r.base_failed]
    assert np.mean([r.kept for r in rows if labels[r.doc_id]]) > 0.97


def test_expectation_maximisation_recovers_accuracies():
    rng = random.Random(4)
    truth = [rng.random() < 0.7 for _ in range(4000)]
    rates = [0.95, 0.9, 0.85, 0.6]
    votes = Counter(tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < a) == t else -1) for a in rates) for t in truth)
    prior, weights = quality_rules.fit(list(votes.items()))
    strength = [w[1] - w[-1] for w in weights]
    assert strength[0] > strength[1] > strength[2] > strength[3]
    assert abs(1 / (1 + np.exp(-prior)) - 0.7) < 0.05
    assert all(abs(w[1] - np.log(a / (1 - a))) < 0.5 for w, a in zip(weights, rates, strict=True))


def test_pieces_match_library(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), sentence_pieces.Pieces(path)
    assert model.by_chunk
    rng = random.Random(6)
    alphabet = ["a", "Zé", " ", "  ", "\n", "\t", "\r\n", "the", ".", "1", "\u00a0", "中", "😀", "\u2581", "\x00", "ß"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(3000)]
    for group in (texts, [t for t in texts if "\u2581" not in t and "\0" not in t]):
        raw, offsets = string_buffer(pa.array(group))
        for i, ids, bounds in model.encode(raw, offsets):
            for k in range(len(bounds) - 1):
                assert ids[bounds[k] : bounds[k + 1]].tolist() == library.encode(group[i + k]), repr(group[i + k])
    for df in (documents(spark), odd(spark)):
        texts = defaultdict(set)
        for r in df.collect():
            ids = library.encode(r.text or "", add_bos=True, add_eos=True)
            texts[r.doc_id].add((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), len((r.text or "").encode())))
        rows = sentence_pieces.digests(df, path).collect()
        assert len(rows) == df.count() and all(tuple(r)[1:] in texts[r.doc_id] for r in rows)
    assert sentence_pieces.digests(odd(spark).limit(0), path).count() == 0


def test_piece_spans(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    model = sentence_pieces.Pieces(path)
    for r in sentence_pieces.encode(odd(spark), path).collect():
        for i, a, b in zip(r.ids, r.starts, r.stops, strict=True):
            assert a <= b
        assert (r.starts[0], r.stops[0]) == (0, 0)
    # Both ways through the normaliser agree, and the pieces tile every text.
    for df in (documents(spark), odd(spark)):
        for r in df.select("text").filter("length(text) < 30000").limit(400).collect():
            raw = (r.text or "").encode()
            whole, walked = model.normalizer._whole(raw), model.normalizer._walk(raw)
            assert whole[0] == walked[0] == model.library.normalize(raw.decode()).encode() or "\0" in r.text
            assert whole[1].tolist() == walked[1].tolist()
            spans = model.spans(raw, np.array(model.library.encode(raw.decode(), add_bos=True, add_eos=True)))
            assert (spans[1:, 0] == spans[:-1, 1]).all() and (not raw or spans[-1, 1] == len(raw)), r.text
    text = "Hello  wörld\nagain".encode()
    ids = model.library.encode(text.decode())
    for (a, b), i in zip(model.spans(text, np.array(ids)).tolist(), ids, strict=True):
        name = model.names[i].decode()
        assert name.startswith("<0x") or text[a:b].decode().replace(" ", "▁").endswith(name.removeprefix("▁"))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_normalizer_follows_the_compiled_map(rule):
    import sentencepiece

    for squeeze in (True, False):
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
        spec = next(v for k, v in sentence_pieces._fields(library.serialized_model_proto()) if k == 3)
        own = sentence_pieces.Normalizer(spec)
        for t in [*ODD, "ｆｕｌｌ width", "①②", "  lead and  trail  ", "Å ångström", "ｶﾞ"]:
            if "\0" in t:
                continue
            normal, source = own.normalize(t.encode())
            assert normal.decode() == library.normalize(t), repr(t)
            assert len(source) == len(normal) + 1 and all(np.diff(source) >= 0)


def test_warc_round_trip(spark, tmp_path):
    import base64

    bodies = ["", None, "a", "a", "é" * 3000, "é" * 3000, "é" * 3000, "b\r\n\r\nWARC/1.1\r\n", "x" * 100_001]
    rows = [(i, f"http://h/{i}\r\n", b, "z", "q") for i, b in enumerate(bodies)] + [(None, None, "a", "z", "q"), (2, "again", "a", "z", "q"), (3, "again", "a", "z", "q")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, chunk string, uid string").repartition(3)
    for least, most in ((0, 200_000), (10, 200_000), (0, 0)):
        manifest = warc.archive(df, "page_id", "url", "html", str(tmp_path / f"a{least}-{most}"), least, chunk_bytes=1000, most_broadcast=most)
        best = defaultdict(lambda: -1)
        for r in rows:
            best[r[2] or ""] = max(best[r[2] or ""], -1 if r[0] is None else r[0])
        expected = []
        for r in rows:
            raw = (r[2] or "").encode()
            again = r[0] != best[r[2] or ""] and len(raw) >= least
            expected.append(str((r[0], len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", best[r[2] or ""] if again else None, True)))
        assert sorted(expected) == sorted(str(tuple(r)) for r in warc.read_archives(manifest).collect())
    assert warc.read_archives(warc.archive(df.limit(0), "page_id", "url", "html", str(tmp_path / "none"))).count() == 0


def test_chunks_carry_digests(spark):
    body = "".join(chr(97 + i % 26) for i in range(2500))
    rows = sorted(warc.chunk_table(spark.createDataFrame([(1, "u", body)], "i long, u string, b string"), "i", "u", "b", 1000).collect(), key=lambda r: r.chunk)
    assert [r.bytes_so_far for r in rows] == [1000, 2000, 2500] and [r["last"] for r in rows] == [False, False, True]
    for r in rows:
        assert r.digest == warc.base32_sha1(hashlib.sha1(body[: r.bytes_so_far].encode()).digest())


def test_language_held_out_accuracy(spark):
    truth = {r.doc_id: (r.lang, r.n_chars) for r in documents(spark).collect()}
    rows = language_id.identify(documents(spark)).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in held]) > 0.97


def test_language_odd_rows(spark):
    rows = language_id.identify(odd(spark)).collect()
    texts = {i: t for i, t in enumerate(ODD)}
    for r in rows:
        t = texts.get(r.doc_id)
        if r.doc_id == 100 or (t is not None and not any(c.isalpha() for c in t)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == "en"
    assert language_id.identify(odd(spark).limit(0)).count() == 0
    nolabel = odd(spark).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in language_id.identify(nolabel).collect()} == {"und"}


def test_texts_without_letters_have_no_language(spark):
    rows = [(i, t, "en") for i, t in enumerate(["plain words", "½ ² ①", "Ⅷ ⅻ 4", "漢字", "ªb", "12 _ 5"] * 3)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).orderBy("doc_id").limit(6).collect()
    assert [r.lang_pred == "und" for r in got] == [False, True, True, False, False, True]


def test_language_learns_every_label(spark):
    rng = random.Random(8)
    words = {f"l{k:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for k in range(70)}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(40)), x) for i, x in enumerate(sorted(words) * 12)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.labels == sorted(words)
    assert np.mean([model.predict(t)[0] == x for _, t, x in rows]) > 0.95


def test_features_count_alike_in_both_ways(monkeypatch):
    for text in ("aé b" * 40_000, "x", "", "word 12 " * 50):
        short = language_id.features(text)
        monkeypatch.setattr(language_id, "_SHORT", 0 if len(text) < 900 else 10**9)
        other = language_id.features(text)
        monkeypatch.undo()
        assert short[0].tolist() == other[0].tolist() and short[1].tolist() == other[1].tolist()


def naive_groups(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0, d))
    out = []
    for text, members in groups.items():
        best = min(members)
        out += [str((m[3], best[3], len(members), hashlib.sha256(text.encode()).hexdigest())) for m in members]
    return sorted(out)


@pytest.mark.parametrize("budget", [exact_dedup.TRIE_BYTES, 2000])
@pytest.mark.parametrize("table", [documents, odd])
def test_exact_groups(spark, table, budget):
    df = table(spark).repartition(3)
    rows = exact_dedup.exact_groups(df, budget).collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in rows) == naive_groups([(r.doc_id, r.text) for r in df.collect()])
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
    kept = exact_dedup.deduplicate(df, budget)
    assert kept.columns == df.columns and kept.count() == len({r.text_sha256 for r in rows})
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


CLASHING = ("_id", "_d", "_digest", "_rank", "_s", "_doc", "id", "row", "key", "n", "host_", "said", "label", "share", "alone", "kept_id", "dropped_id", "uid", "body", "total", "words", "lang_pred", "digest", "goes")


def with_clashes(df):
    return df.withColumns({c: F.lit("z") for c in CLASHING if c not in df.columns})


def test_columns_of_any_name_pass(spark, tmp_path):
    """No column of the input may meet a name that an operator uses itself."""
    docs, path = documents(spark).limit(60), tokenizer_path("byte_bpe_50k.json")
    pages, talks = spark.read.parquet(f"{SF}/pages.parquet").limit(40), spark.read.parquet(f"{SF}/conversations.parquet").limit(40)
    both = lambda df, f: [sorted(map(str, f(x).collect())) for x in (df, with_clashes(df))]
    plain = [
        both(docs, ngram_join.jaccard_components), both(talks, lambda x: chat_format.read_packs(chat_format.pack(x))), both(docs, lambda x: token_planes.read_tokens(token_planes.write_tokens(x, path))),
        both(docs, quality_rules.judge), both(docs, lambda x: sentence_pieces.digests(x, tokenizer_path("piece_bpe_32k.model"))), both(docs, language_id.identify),
        both(docs, lambda x: exact_dedup.exact_groups(x).drop("uid")), both(docs, mixing.mix), both(pages, lambda x: warc.read_archives(warc.archive(x, "page_id", "url", "html", None))),
    ]
    assert all(a == b for a, b in plain)
    shared = docs.unionByName(docs.limit(5))
    for df, f in ((docs, exact_dedup.deduplicate), (shared, exact_dedup.deduplicate), (docs, ngram_join.one_of_each), (docs, mixing.mixed), (docs, language_id.accepted), (pages, url_filter.judge_urls)):
        wide = with_clashes(df)
        got, bare = f(wide), f(df)
        assert set(wide.columns) <= set(got.columns)
        assert sorted(map(str, got.select(bare.columns).collect())) == sorted(map(str, bare.collect()))
        assert {tuple(r) for r in got.select(*[c for c in CLASHING if c not in df.columns]).collect()} <= {("z",) * len([c for c in CLASHING if c not in df.columns])}


def test_megabytes_of_text(spark, tmp_path):
    """One text of 3 MB goes through every operator whole."""
    rng = random.Random(12)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) + str(rng.randrange(10**6)) for _ in range(260_000))
    rows = [(1, long, "en", "s"), (2, long + " tail", "en", "s"), (3, "a short text", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    n = len(WORDS.findall(long))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()} == {d: (len(shingles(t)), min(d, 1) if d < 3 else 3) for d, t, *_ in rows}
    assert {r.doc_id: r.n_words for r in quality_rules.judge(df).collect()} == {1: n, 2: n + 1, 3: 3}
    assert {r.doc_id: (r.group_size, r.text_sha256) for r in exact_dedup.exact_groups(df).collect()}[1] == (1, hashlib.sha256(long.replace(" ", "").encode()).hexdigest())
    assert {r.doc_id: r.size for r in mixing.mix(df).collect()}[1] == n
    packs = chat_format.read_packs(chat_format.pack(df.selectExpr("doc_id conv_id", "0L turn", "'assistant' role", "text")))
    assert {r.conv_id: r.loss_sha256 for r in packs.collect()}[1] == hashlib.sha256(long.encode()).hexdigest()
    archived = warc.read_archives(warc.archive(df, "doc_id", "source", "text", None)).collect()
    assert {r.page_id: (r.payload_bytes, r.verified) for r in archived}[2] == (len(long) + 5, True)
    assert language_id.identify(df).count() == 3
    for r in sentence_pieces.digests(df, tokenizer_path("piece_bpe_32k.model")).collect():
        assert r.covered_bytes == len(rows[r.doc_id - 1][1])
    assert token_planes.read_tokens(token_planes.write_tokens(df, tokenizer_path("byte_bpe_50k.json"))).count() == 3


def test_rows_without_conversation_stand_alone(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 0, "user", "a"), (4, 0, "user", "a")]
    packs = chat_format.pack(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted((r.conv_id or 0, r.n_turns, r.loss_chars) for r in chat_format.read_packs(packs).collect()) == [(0, 1, 0), (0, 1, 0), (0, 1, 1), (4, 1, 0)]


def test_one_of_each_spares_other_texts_of_an_identifier(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(1, base), (2, base + " x"), (2, "another text that nothing else is like at all"), (None, base), (3, base + " y")]
    got = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, len(r.text)) for r in got) == sorted((d or 0, len(t)) for d, t in rows[:4])


def test_materialized_tables_are_removed(spark, tmp_path, monkeypatch):
    from itertools import count

    from cladeworks.llm import runtime

    number = count()
    monkeypatch.setattr(runtime, "shared_dir", lambda spark: f"{tmp_path}/{next(number)}")
    df = ngram_join.jaccard_components(documents(spark).limit(200))
    assert len(list(tmp_path.iterdir())) == 2 and next(number) > 10 and df.count() == 200


def test_patricia_trie():
    rng = random.Random(9)
    keys = ["".join(rng.choice("ab") for _ in range(rng.randrange(12))).encode() for _ in range(500)]
    trie, found = exact_dedup.PatriciaTrie(), Counter()
    for k in keys:
        node = trie.node(k)
        node[2] = (node[2] or 0) + 1
        if rng.random() < 0.02:
            for key, n in trie.spill():
                found[key] += n
    for key, n in trie.items():
        found[key] += n
    assert found == Counter(keys)


def test_mixing_meets_targets(spark):
    df = documents(spark)
    rows = mixing.mix(df).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert r.taken in (0, r.size, 2 * r.size)
    total = sum(r.size for r in rows)
    assert abs(sum(x[0].target for x in by.values()) - 1.5 * total) < 1e-6 * total
    for x in by.values():
        assert abs(sum(r.taken for r in x) - x[0].target) <= max(r.size for r in x) and x[0].target <= 2 * x[0].source_size + 1e-6
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mixed(df).count() == sum(r.times for r in rows)


def test_mixing_odd_rows(spark):
    df = odd(spark)
    rows = mixing.mix(df).collect()
    assert len(rows) == df.count() and all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed(df).columns == df.columns


def test_rows_of_one_identifier_are_mixed_apart(spark):
    rows = [(7, f"word{i} " * 10, "s") for i in range(200)] + [(None, f"other{i} " * 10, "t") for i in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for name in "st":
        mine = [r for r in got if r.source == name]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 20


def test_larger_mixes_contain_smaller_ones(spark):
    small = {r.doc_id: r.taken for r in mixing.mix(documents(spark), share=0.5).collect()}
    large = {r.doc_id: r.taken for r in mixing.mix(documents(spark), share=1.2).collect()}
    assert all(large[d] >= t for d, t in small.items())


def test_mixed_rows_keep_columns_of_any_name(spark):
    df = documents(spark)
    for name in ("_row", "_s", "_times", "_copy", "whole", "threshold", "target", "times"):
        df = df.withColumn(name, F.col("doc_id"))
    times = {r.doc_id: r.times for r in mixing.mix(df).collect()}
    rows = mixing.mixed(df).collect()
    assert {k: n for k, n in times.items() if n} == Counter(r.doc_id for r in rows)
    assert all(r["times"] == r["whole"] == r["_row"] == r.doc_id for r in rows)


def test_larger_tables_are_not_broadcast(spark, tmp_path):
    """Half a million narrow rows, a few MB as a file, are 50 MB in a hash table of the driver, and more while it is built."""
    spark.range(500_000).selectExpr("id as k", "id % 7 as v").coalesce(1).write.parquet(f"{tmp_path}/t")
    side, rows = spark.read.parquet(f"{tmp_path}/t"), spark.range(1_000_000).withColumnRenamed("id", "k")
    plan = lambda n: rows.join(broadcast_if_small(side.limit(n)), "k", "left")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan(1000) and "Broadcast" not in plan(500_000)


def test_counting_frequent_shingles_takes_little_memory(monkeypatch):
    """A task's counts are made in the memory that holds the shingles; a count is not lost where that is full."""
    import tracemalloc

    texts = [" ".join(f"w{i}x{k}" for i in range(20_000)) for k in range(190)] + [" ".join(["again"] * 5 + [f"v{k}"]) for k in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    monkeypatch.setattr(ngram_join, "_SLICE_ROWS", 8)
    run = ngram_join._sets(5)
    tracemalloc.start()
    out = list(run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    counted = [c for b in out for c in b.column(5).to_pylist() if c is not None]
    assert counted == [40] and peak < 90 << 20


def test_join_broadcasts_only_counted_tables(spark, monkeypatch):
    """Files of repeated keys are far smaller than their rows: whether a table goes to the driver is decided by its rows, never by its file."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "MOST_BROADCAST", -1, raising=False)
    monkeypatch.setattr(ngram_join, "broadcast_if_small", lambda df: broadcast_if_small(df, -1))
    broadcast, put = [], ngram_join.materialize

    def planned(df, name):
        if "Broadcast" in df._jdf.queryExecution().sparkPlan().toString():
            broadcast.append(name)
        return put(df, name)

    monkeypatch.setattr(ngram_join, "materialize", planned)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(w if rng.random() > 0.05 else f"e{rng.randrange(10**6)}" for w in base)) for i in range(300)]
    found = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert not broadcast and "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == components(rows)
