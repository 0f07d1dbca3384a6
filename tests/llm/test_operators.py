"""Corpus operators against brute force, on small tables with odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tideframe.llm import chat, copies, langid, mtree, packing, pieces, quality, queries, records, simhash, suffix, tokens, urls
from tideframe.llm.common import tokenizer_file

from tests.compare import connect, spark_rows, sql_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank string, k1 string"
WORDS = ["ab", "b", "éa", "xyz", "a", "zz", "ß", "漢字", "x|y", "\t", "\n"]


def docs(spark, rows):
    """Rows (doc_id, text) with further columns, some of whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), "r", "k") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base = text(60)
    rows = [(0, None), (1, ""), (2, " \n\t "), (None, "null id"), (3, "a" * 900), (4, text(3000))]
    rows += [(5, base), (5, base), (6, base), (7, base + " tail"), (8, "x" + base), (9, "Ab ab AB")]
    rows += [(10 + k, text(rng.randrange(1, 80))) for k in range(25)] + [(40 + k, text(5) + base + text(5)) for k in range(15)]
    return rows


def brute_removed(texts, window):
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("window,hot", [(13, 128), (30, 128), (30, 2), (120, 128)])
def test_suffix_dedup(spark, odd, monkeypatch, window, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    texts = [(t or "").encode() for _, t in odd]
    want = sorted(
        (str(i), len(t), int(g.sum()), int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~g].tobytes()).hexdigest())
        for (i, _), t, g in zip(odd, texts, brute_removed(texts, window), strict=True)
    )
    got = suffix.repeated_spans(docs(spark, odd), window=window).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


@pytest.mark.parametrize("alphabet,length,window", [(b"a", 50, 7), (b"ab", 400, 9), (bytes(range(256)), 500, 3), (b"ab\x00\xff", 300, 16)])
def test_two_stage_sort(alphabet, length, window):
    rng = random.Random(length)
    strings = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(window, length))) for _ in range(6)]
    block = suffix.Block(strings, [len(s) - window + 1 for s in strings], window)
    order = block.sort()
    keys = [block.text[p : p + window] for p in order]
    assert keys == sorted(keys) and len(set(order.tolist())) == len(order) and set(np.flatnonzero(block.wanted)) <= set(order.tolist())
    seen = Counter(block.text[p : p + window] for p in np.flatnonzero(block.wanted))
    repeated = block.repeated()
    assert all(repeated[p] == (seen[block.text[p : p + window]] > 1) for p in np.flatnonzero(block.wanted))


def test_pieces_cover_each_start_once():
    rng = random.Random(8)
    for window in (5, 40, 400):
        for _ in range(10):
            t = bytes(rng.choice(b"abc ") for _ in range(rng.randrange(0, 1500)))
            starts = sorted(x for _, _, _, at in suffix.pieces([t], window) for p in at.tolist() for lo, _, n in [suffix.opened(p)] for x in range(lo, lo + n))
            assert starts == list(range(max(0, len(t) - window + 1)))


def test_segments_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SEGMENT", 64)
    rows = [(1, "abcdefghij" * 30), (2, "xy" + "abcdefghij" * 9)]
    texts = [t.encode() for _, t in rows]
    for t in texts:
        starts = sorted(x for _, _, _, at in suffix.pieces([b"", t, b"z" * 19], 20) for p in at.tolist() for lo, _, n in [suffix.opened(p)] for x in range(lo, lo + n))
        assert starts == list(range(len(t) - 19))


def test_cutting_keeps_valid_text_and_columns(spark, odd):
    df = docs(spark, odd)
    out = suffix.without_repeats(df, window=30)
    assert out.columns == df.columns
    rows = out.collect()
    assert len(rows) == len(odd) and all(r["n_chars"] == len(r["text"] or "") for r in rows)
    assert sum(r["doc_id"] == 5 and r["text"] == "" for r in rows) == 2


def brute_components(fps, ids, radius=4):
    top = list(range(len(fps)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                top[max(find(a), find(b))] = min(find(a), find(b))
    groups = defaultdict(list)
    for k in range(len(fps)):
        groups[find(k)].append(k)
    return {k: min((ids[j] for j in g if ids[j] is not None), default=None) for g in groups.values() for k in g}


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, odd, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 8)
    monkeypatch.setattr(simhash, "BUCKET", 4)
    fps = [slow_fingerprint(t or "") for _, t in odd]
    comp = brute_components(fps, [i for i, _ in odd])
    want = sorted((str(i), f"{fp:016x}", str(comp[k])) for k, ((i, _), fp) in enumerate(zip(odd, fps, strict=True)))
    got = simhash.near_duplicates(docs(spark, odd)).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want


def links_of(fp, size, radius, least):
    home = np.zeros(len(fp), simhash.items_type(1))
    home["key"], home["fp"], home["size"] = np.arange(len(fp)), fp[:, None], size
    tree = simhash.VantageTree(fp, size, 16, radius, least)
    where = dict(tree.route(fp, size, -1))
    assert sorted(np.concatenate(list(where.values())).tolist()) == list(range(len(fp)))
    for q, h in simhash.link(home, tree, where, home, radius, 0, least):
        yield from zip(q.tolist(), h.tolist(), strict=True)


def test_sizes_prune_without_loss():
    rng = np.random.default_rng(9)
    fp = np.unique(rng.integers(0, 2**63, 500, dtype=np.int64).view(np.uint64))
    size = rng.integers(0, 60, len(fp))
    got = {frozenset(p) for p in links_of(fp, size, 30, 0.8)}
    near = [(a, b) for a in range(len(fp)) for b in range(a) if int(fp[a] ^ fp[b]).bit_count() <= 30 and min(size[a], size[b]) >= 0.8 * max(size[a], size[b])]
    assert got == {frozenset(p) for p in near} and len(got) > 100


def test_vantage_search_finds_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400, dtype=np.int64).view(np.uint64)
    near = base[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))
    every = np.unique(np.concatenate([base, near, [np.uint64(0), np.uint64(2**64 - 1)]]))
    got = set(links_of(every, np.zeros(len(every), np.int64), 4, None))
    want = {(a, b) for a in range(len(every)) for b in range(len(every)) if a != b and int(every[a] ^ every[b]).bit_count() <= 4}
    assert got == want and len(want) >= 300


def test_chain_of_links(spark):
    """Components reach over many links."""
    chain = spark.createDataFrame([(k + 1, k) for k in range(60)] + [(200, 201)], "a long, b long")
    got = {r["fp"]: r["root"] for r in simhash.components(chain).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 201: 200}


def test_quality(spark, odd):
    got = quality.quality_ledger(docs(spark, odd)).collect()
    want = []
    for i, t in odd:
        t = t or ""
        words = t.encode().split()
        lines = [x for x in t.split("\n") if x.encode().split()]
        grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(k, k + 3)}
        want.append((str(i), len(words), sum(len(w.decode()) for w in words), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)))
    assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == sorted(want)


def test_policies_and_ablation(spark):
    good = " ".join(f"word{k}" for k in range(60))
    rows = [(1, good), (2, "few"), (3, good + " |" * 40), (4, None)]
    ledger = quality.quality_ledger(docs(spark, rows))
    kept = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.apply_policy(ledger).collect()}
    assert kept == {1: (False, True), 2: (True, False), 3: (False, False), 4: (True, False)}
    assert {r["doc_id"] for r in quality.apply_policy(ledger, "base").where("kept").collect()} == {1, 3}
    rules = {r["rule"]: (r["n_failed"], r["n_failed_alone"], r["n_kept_without"]) for r in quality.ablation(ledger).collect()}
    assert rules["few_words"][0] == 2 and rules["symbols"][0] == 1
    assert [r["doc_id"] for r in quality.keep_good(docs(spark, rows)).collect()] == [1]


def test_langid_held_out(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit_langid(table)
    found = langid.detect_languages(table, model).join(table.select("doc_id", "lang"), "doc_id")
    held = found.where(langid.fold(F.col("doc_id")) == 2)
    right = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.95 and held.agg(F.avg(F.col("accepted").cast("int"))).first()[0] >= 0.98
    odd = docs(spark, [(1, None), (2, "123 !? ---"), (3, ""), (None, "the of and thing")])
    rows = {r["doc_id"]: r for r in langid.detect_languages(odd, model).collect()}
    assert all(rows[k]["lang_pred"] == "und" and rows[k]["score"] == 0 and not rows[k]["accepted"] for k in (1, 2, 3))
    assert rows[None]["lang_pred"] in model.langs
    assert langid.fit_langid(odd.where("false")) is None


def test_langid_blocks_agree(monkeypatch):
    """Block borders change nothing."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdé ß") for _ in range(rng.randrange(1, 60))) for _ in range(50)]
    x = rng.random()
    model = langid.LangModel(["p", "q"], np.random.default_rng(1).normal(size=(1 << langid.BUCKET_BITS, 2)).astype(np.float32), np.zeros(2), 1.0, x)
    whole = langid.predict(model, texts)
    freq = [langid.counts(t) for t in texts]
    monkeypatch.setattr(langid, "_BLOCK", 16)
    parts = langid.predict(model, texts)
    assert whole[0] == parts[0] and np.allclose(whole[1], parts[1])
    for t, f in zip(texts, freq, strict=True):
        assert (langid.counts(t) == f).all()
        if langid._LETTER.search(t):
            p = langid.softmax((f @ model.weights / f.sum())[None, :])
            assert abs(p.max() - whole[1][texts.index(t)]) < 1e-4


ODD_TEXTS = ["", " ", "  a", "a  b ", "it's", "<|endoftext|> x", "\n\n a\n", "é ÉCOLE ﬁ", "e\u0301", "漢字 kana", "\u00a0x\u3000y", "a▁b ▁", "x\x1cy\x85z", "0123 45a", "_-_", "'S 'll", "İ ſ Σς", "😀 😀!"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_tables_equal_the_library(name):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    letters = "".join(ODD_TEXTS) + "abcdefgh    \n\n.,!"
    texts = ODD_TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(1500)]
    encoder, library = tokens.WordEncoder(tokenizer_file(name)), Tokenizer.from_file(tokenizer_file(name))
    encoder.table.limit = encoder.plain.limit = 50  # forgetting must not change anything
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(part)]
        assert got == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]


def test_pieces_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    rows = [*enumerate(ODD_TEXTS), (99, None), (99, "twice"), (99, "twice"), (None, "id")]
    got = pieces.encode_pieces(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = Counter()
    for _, t in rows:
        ids = model.encode(t or "")
        want[(len(ids), tuple(ids), model.decode(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())] += 1
    assert Counter((r["n_tokens"], tuple(r["ids"]), r["decoded"], r["ids_sha256"]) for r in got) == want


def test_packing_documents(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    limits = packing.Limits(64, 5, 64)
    got = packing.pack_documents(docs(spark, [(k, t) for k, (_, t) in enumerate(odd)]), limits=limits, with_ids=True).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] * 4 == len(r["ids"])
    for k, (_, t) in enumerate(odd):
        parts = sorted(by_doc[k], key=lambda r: r["start"])
        ids = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in parts]).tolist()
        assert ids == library.encode(t or "", add_special_tokens=False).ids + [1]
        assert all(p["doc_tokens"] == len(ids) for p in parts) and [p["start"] for p in parts] == np.cumsum([0] + [p["length"] for p in parts])[:-1].tolist()
    for parts in by_seq.values():
        parts.sort(key=lambda r: r["offset"])
        lengths = [p["length"] for p in parts]
        assert [p["offset"] for p in parts] == np.cumsum([0] + lengths)[:-1].tolist() and sum(lengths) <= 64 and len(parts) <= 5


@pytest.mark.parametrize("cut", [True, False])
def test_vector_limits(cut):
    """Tokens, segments and loss-bearing tokens hold at once; every token is placed once."""
    rng = random.Random(1)
    limits = packing.Limits(100, 4, 40)
    items = [(k, n := rng.randrange(1, 41 if not cut else 300), rng.randrange(0, min(n, 40) + 1)) for k in range(300)]
    packer = packing.Packer(limits, cut=cut, pool=32)
    placed = [p for k, n, loss in items for p in packer.add(packing.Example(k, 0, n, n, loss))] + list(packer.finish())
    seq, tokens_of = defaultdict(list), defaultdict(list)
    for p in placed:
        seq[p.sequence].append(p)
        tokens_of[p.example.owner] += range(p.example.start, p.example.stop)
    assert all(sorted(tokens_of[k]) == list(range(n)) for k, n, _ in items)
    for parts in seq.values():
        assert sum(p.example.tokens for p in parts) <= 100 and len(parts) <= 4 and sum(p.example.bearing() for p in parts) <= 40
    if not cut:
        assert len(placed) == len(items)
        with pytest.raises(ValueError):
            list(packer.add(packing.Example("x", 0, 101, 101, 0)))


def test_records_round_trip(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    manifest = records.write_records(docs(spark, odd), f"file://{tmp_path}/out")
    got = sorted(records.scan_records(spark, manifest).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i)) and len(got) == len(odd)
    want = Counter((str(i), zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes())) for i, t in odd)
    assert Counter((str(r["doc_id"]), r["ids_crc32"]) for r in got) == want
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    path = max(manifest, key=lambda m: m["records"])["path"]
    in_order = [(i, x.tolist()) for i, x in records.read_records(path)]
    shuffled = [(i, x.tolist()) for i, x in records.read_shuffled(path, 3)]
    assert sorted(map(str, in_order)) == sorted(map(str, shuffled)) and len(records.read_index(path + ".idx")) == len(in_order)


def test_torn_records(tmp_path):
    ids = np.arange(9, dtype="<u2")
    data = records.frame(records.payload_of(7, ids)) + records.frame(records.payload_of(None, ids))
    for damage in (data[:-1], data[:5], data[:20] + b"\xff" + data[21:], b"\x01" + data[1:]):
        (tmp_path / "x").write_bytes(damage)
        with pytest.raises(records.TornRecord):
            list(records.read_records(str(tmp_path / "x")))
    (tmp_path / "x").write_bytes(data)
    assert [i for i, _ in records.read_records(str(tmp_path / "x"))] == [7, None]


def test_url_rules(spark):
    rules = queries.URL_RULES
    cases = {
        "https://A.Example.ORG/en/17?x": ("a.example.org", "/en/17", "example.org/en/1", "block"),
        "http://example.org/es/": ("example.org", "/es/", "example.org/es/", "block"),
        "http://example.org/es": ("example.org", "/es", "org/", "allow"),
        "http://example.org": ("example.org", "", None, "allow"),
        "x://notexample.org/en/1#f": ("notexample.org", "/en/1", "org/", "allow"),
        "http://b.com/de/1": ("b.com", "/de/1", "com/de/", "block"),
        "http://com/de/": ("com", "/de/", "com/de/", "block"),
        "http://b.com:80/de/1": ("b.com:80", "/de/1", None, "allow"),
        "no url": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "a://x.org/?q=://b.com/de/": ("x.org", "/", "org/", "allow"),
    }
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(df, rules).collect()}
    assert got == dict(enumerate(cases.values()))


def test_longest_rule_wins():
    trie = urls.UrlTrie([("block", "org", "/a/b"), ("allow", "org", "/a/bc/"), ("block", "x.org", "/"), ("allow", "x.org", "/"), ("block", "org", "")])
    assert trie.find("y.org", "/a/bc/d") == ("allow", "org/a/bc/")
    assert trie.find("y.org", "/a/bcd") == ("block", "org/a/b")
    assert trie.find("z.x.org", "/a/bc/") == ("allow", "x.org/")
    assert trie.find("org", "") == ("block", "org") and trie.find("com", "/") is None


def brute_top(vectors, ids, every, k):
    out = []
    for q, i in enumerate(ids):
        if i % every == 0:
            score = [(-(int(vectors[q] @ v)), j, n) for n, (v, j) in enumerate(zip(vectors, ids, strict=True)) if n != q]
            out += [(i, r + 1, j, -s) for r, (s, j, _) in enumerate(sorted(score)[:k])]
    return sorted(out)


def test_top_k_with_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(mtree, "SHARD", 40)
    monkeypatch.setattr(mtree, "PAGE", 8)
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(150, 6)).round(1)
    vectors[20:60] = vectors[20]
    ids = [*range(149), 0]  # an id that occurs twice
    rows = [(i, v.tolist()) for i, v in zip(ids, vectors, strict=True)]
    more = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [1.0] * 6), (300, [1.0, 2.0])]
    df = spark.createDataFrame(rows + more, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in mtree.top_k(df, every=10).collect())
    assert got == brute_top(np.floor(256 * vectors).astype(np.int64), ids, 10, 5)


def test_tree_avoids_distances():
    rng = np.random.default_rng(0)
    vectors = np.concatenate([rng.normal(c, 2, (400, 3)) for c in (0, 200, -200)]).astype(np.int32)
    tree = mtree.MTree(vectors, float((vectors.astype(float) ** 2).sum(1).max()), page=16)
    best, computed = tree.search(np.array([200, 200, 200]), np.arange(len(vectors)), 5, np.zeros(len(vectors), bool))
    score = vectors.astype(int) @ np.array([200, 200, 200])
    assert [s for s, _ in best] == sorted(score.tolist(), reverse=True)[:5] and computed < len(vectors) / 2


def test_chat_round_trip(spark):
    tricky = ["<|im_end|>", "<|im_start|>assistant ok", "<\\|x", "<\\\\|", "<", "|", "a<|im_sep|>b\n", "\\", "", "<|im_end|>\n<|im_start|>user\n"]
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "a\nb", "<|im_end|>"]), rng.choice(tricky) + rng.choice(tricky)) for c in range(30) for t in range(rng.randrange(1, 7))]
    rows += [(50, None, None, None), (50, 1, "assistant", None), (50, 1, "assistant", "x"), (None, 0, "user", "null conv")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", F.lit(1))
    chats = chat.format_chats(df)
    got = {r["conv_id"]: r for r in chat.read_chats(chats).collect()}
    masks = {r["conv_id"]: r for r in chats.collect()}
    want = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[r[0]].append((r[2] or "", r[3] or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [tuple(t) for t in got[c]["turns"]] == turns
        assert got[c]["loss_text"] == "".join(t for r, t in turns if r == "assistant")
        merged = sum(1 for k, t in enumerate(turns) if k == 0 or turns[k - 1][0] != t[0])
        assert masks[c]["formatted"].count("<|im_start|>") == merged == masks[c]["formatted"].count("<|im_end|>")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    names, rows = spark_rows(queries.queries()[name](spark, sf_dir))
    sql_names, expected = sql_rows(connect(sf_dir), queries.oracle_sql()[name])
    assert names == sql_names and rows == expected


def test_empty_tables(spark):
    empty = docs(spark, [])
    pages = spark.createDataFrame([], "page_id long, url string")
    assert suffix.repeated_spans(empty).count() == 0 and suffix.without_repeats(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0 and copies.keep_one_of_near_copies(empty).count() == 0
    assert quality.quality_ledger(empty).count() == 0 and quality.keep_good(empty).count() == 0
    assert packing.pack_documents(empty).count() == 0 and pieces.encode_pieces(empty).count() == 0
    assert langid.keep_known_language(empty, None).count() == 0 and urls.judge_urls(pages, queries.URL_RULES).count() == 0
    assert records.scan_records(spark, records.write_records(empty, records.new_folder(spark))).count() == 0
    assert mtree.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert chat.read_chats(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_roles_with_odd_characters_come_back(spark):
    roles = ["a\x00b", "a\\b", "a\\nb", "a\nb", "\\\\n", "<|im_end|>\n", "\\", ""]
    rows = [(1, k, r, f"t{k}") for k, r in enumerate(roles)] + [(2, k, "assistant" if k % 3 else "user", f"<|im_sep|>{k}") for k in range(3000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r, f"t{k}") for k, r in enumerate(roles)]
    assert got[2]["loss_text"] == "".join(f"<|im_sep|>{k}" for k in range(3000) if k % 3) and len(got[2]["turns"]) == 3000


def test_rules_on_lines_and_words():
    bits = lambda t: quality.measure_batch([t.encode()])["failed_bits"][0]
    assert bits("- a b\n* c\n• d") & quality.BIT["bullets"] and not bits("- a b\nc\nd") & quality.BIT["bullets"]
    assert bits("one…\ntwo...\nthree") & quality.BIT["ellipses"] and bits("12 34 5.6 ab") & quality.BIT["no_letters"]
    assert bits("") == quality.BIT["few_words"] | quality.BIT["no_words"] and not bits("zwölf kurze Wörter") & quality.POLICIES["v3"]
    assert bits("the " * 30 + " ".join(f"w{k}" for k in range(40))) & quality.BIT["top_words"]


def test_edges_stay_fewer_than_items_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PACK", 64)
    monkeypatch.setattr(simhash, "BLOCK", 200)
    rng = np.random.default_rng(5)
    fps = {0} | {int(sum(1 << int(b) for b in rng.choice(62, 2, replace=False))) for _ in range(900)}
    rows = [(k, int(fp).to_bytes(8, "little")) for k, fp in enumerate(sorted(fps))]
    items = spark.createDataFrame(rows, "key long, fp binary").repartition(16)
    found = simhash.edges(items, 4, shard=300)
    # one edge for each item and block that it visits, at most, and there are about 15 blocks; pairs are 258,000
    assert found.count() <= 16 * len(rows)
    tops = simhash.components(found).collect()
    assert len(tops) == len(rows) - 1 and {r["root"] for r in tops} == {0}
