"""The ten operators against brute force, and on nulls, empty and very long texts, ties, repeats and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quireflow.llm import exact_dedup, fingerprints, graph, html_text, licenses, mixing, near_dedup, packing, quality, suffix_dedup, textkit, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "size long, _row long, kept boolean, component long, key string, log_weight double, _c0 int"
LONG = "long " * 40_000


def frame(spark, rows, extra=False):
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
    if extra:
        return spark.createDataFrame([(*r, 7, 8, False, 9, "k", 0.5, 3) for r in rows], f"{SCHEMA}, {CLASHING}")
    return spark.createDataFrame(rows, SCHEMA)


def stored(df, tmp_path, name="docs"):
    """df as a table, which reads the same way each time."""
    df.write.parquet(str(tmp_path / name))
    return df.sparkSession.read.parquet(str(tmp_path / name))


ODD = [(1, "Some Text here. And more!", "a"), (2, "some text HERE. and more!", "a"), (3, None, None), (4, "", "b"), (5, "  \n", "b"), (6, LONG, "b"), (7, "été İ ß", None), (7, "été İ ß", None), (None, "no id", "c")]


# 7


def test_exact_groups(spark):
    found = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.exact_groups(frame(spark, ODD, extra=True)).collect()}
    by_id = {k[0]: r for k, r in found.items()}
    assert by_id[1]["keep_id"] == 2 and not by_id[1]["kept"] and by_id[2]["kept"] and by_id[2]["group_size"] == 2
    assert by_id[3]["keep_id"] == 4 and by_id[4]["group_size"] == 2
    assert by_id[2]["text_sha256"] == hashlib.sha256(b"some text here. and more!").hexdigest()
    assert by_id[None]["kept"]
    both = [r["kept"] for r in exact_dedup.exact_groups(frame(spark, ODD)).collect() if r["doc_id"] == 7]
    assert sorted(both) == [False, True]


def test_exact_groups_past_hash_collisions(spark):
    rnd = random.Random(1)
    rows = [(k, "".join(rnd.choice("ab.") for _ in range(rnd.randint(0, 40))), "a") for k in range(300)]
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t, []).append(i)
    for bits in (2, 64):
        found = exact_dedup.exact_groups(frame(spark, rows), hash_bits=bits, least=4, most=8).collect()
        assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in found} == {i: (max(g), len(g)) for g in groups.values() for i in g}


def test_exact_groups_of_nothing(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


def test_chunks_cover_the_text():
    pattern = re.compile(exact_dedup.chunk_pattern(8, 32))
    for text in ("", "a", "x" * 100, "One. Two! Three? " * 20, "\n\n\n"):
        assert "".join(pattern.findall(text)) == text


def test_drop_copies_gives_rows_back(spark, tmp_path):
    docs = stored(frame(spark, ODD, extra=True), tmp_path)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter([2, 4, 5, 6, 7, None])
    assert {r["_row"] for r in left.collect()} == {8}


@pytest.mark.parametrize("size", ["1k", "64m"])
def test_drop_copies_with_another_split_of_the_table(spark, tmp_path, size):
    rows = [(k % 40, f"text {k % 40}" if k % 3 else f"TEXT {k % 40}", "ab"[k % 2]) for k in range(120)]
    docs = stored(frame(spark, rows, extra=True).repartition(9), tmp_path)
    left = exact_dedup.drop_copies(docs)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        assert sorted(r["doc_id"] for r in left.collect()) == list(range(40))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


# 8


def brute_components(rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t, _ in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_rows(seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 5)))
    rows, k = [], 0
    for _ in range(12):
        base = [word() for _ in range(rnd.choice((3, 20, 60, 200)))]
        for _ in range(rnd.randint(1, 9)):
            t = list(base)
            for _ in range(rnd.randint(0, 1 + len(t) // 25)):
                t[rnd.randrange(len(t))] = word()
            rows.append((k, " ".join(t), "a"))
            k += 1
    return [*rows, (900, None, "a"), (901, "", "a"), (902, " \n ", "a"), (903, "one", "a"), (904, "ONE", "a"), (905, LONG, "a"), (906, LONG + "end", "a")]


def test_near_duplicates(spark):
    rows = near_rows()
    want = brute_components(rows)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(frame(spark, rows, extra=True)).collect()}
    assert found == want
    assert len({c for _, c in want.values()}) < len(rows)


def test_near_duplicates_of_an_id_with_a_copy_and_another_text(spark, tmp_path):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    docs = stored(frame(spark, [(3, a, "a"), (7, a, "a"), (7, b, "a"), (9, b + " more", "a"), (11, "another text of its own", "a")]), tmp_path)
    found = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert found == {(3, 3, True), (7, 3, False), (9, 3, False), (11, 11, True)}


def test_near_duplicates_of_nothing_and_without_id(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    found = near_dedup.near_duplicates(frame(spark, [(None, "a b c d e f", "x"), (2, "a b c d e f", "x")])).collect()
    assert all(r["kept"] for r in found)


def test_sketch_allows_every_linked_pair():
    rnd = np.random.default_rng(5)
    for n in (8, 150, 3000):
        for _ in range(40):
            common = rnd.integers(0, 2**63, int(n * 6 / 7) + 1, dtype=np.uint64)
            sets = [np.unique(np.concatenate([common, rnd.integers(0, 2**63, n - len(common), dtype=np.uint64)])) * np.uint64(2) for _ in range(2)]
            first = np.cumsum([0, len(sets[0]), len(sets[1])])
            both = near_dedup._sketches(np.concatenate(sets), first).view(np.uint64)
            words = both[:, : (1 + near_dedup.RANGE_BITS) * near_dedup.WORDS].reshape(2, 1 + near_dedup.RANGE_BITS, near_dedup.WORDS)
            maps = both[:, (1 + near_dedup.RANGE_BITS) * near_dedup.WORDS :]
            assert sum(int(x).bit_count() for x in maps[0] ^ maps[1]) <= len(set(sets[0]) ^ set(sets[1]))
            odd = np.bitwise_or.reduce(words[0] ^ words[1], axis=0)
            differ = sum(int(x).bit_count() for x in odd)
            used = sum(int(x).bit_count() for x in words[0, 0] | words[1, 0])
            undrawn = max(0.05, 1 - used * 1.75 / sum(map(len, sets)))
            assert differ <= 0.25 * used + near_dedup.DEVIATIONS * (0.1875 * used * undrawn) ** 0.5 + 2


def test_keys_meet_under_the_distance_threshold():
    rnd = np.random.default_rng(2)
    for _ in range(50):
        a = rnd.integers(0, 1 << 16, near_dedup.MINIMA)
        b = a.copy()
        b[rnd.choice(near_dedup.MINIMA, 2 * near_dedup.CHUNKS - 1, replace=False)] ^= 1
        errors = (a != b).reshape(near_dedup.CHUNKS, near_dedup.CHUNK_SYMBOLS).sum(axis=1)
        assert errors.min() <= 1


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    rnd = random.Random(4)
    rnd.shuffle(chain)
    found = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}}


# 10


def brute_removal(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def repeats(seed, n):
    rnd = random.Random(seed)
    passages = ["".join(rnd.choice("abcd é") for _ in range(rnd.randint(20, 150))) for _ in range(12)]
    rows = []
    for i in range(n):
        t = ""
        for _ in range(rnd.randint(0, 5)):
            if rnd.random() < 0.5:
                p = rnd.choice(passages)
                a = rnd.randrange(len(p))
                t += p[a : a + rnd.randint(1, 150)]
            else:
                t += "".join(rnd.choice("abcd é") for _ in range(rnd.randint(0, 60)))
        if rnd.random() < 0.1:
            t = rnd.choice(["ab ", "xyz", "q"]) * rnd.randint(1, 60)
        rows.append((i, None if rnd.random() < 0.05 else t, "a"))
    return [*rows, *((n + k, rows[k][1], "a") for k in range(8)), (5000, LONG[:3000], "a")]


@pytest.mark.parametrize(("seed", "share"), [(1, 40), (2, 20_000)])
def test_removal_of_repeats(spark, monkeypatch, seed, share):
    monkeypatch.setattr(suffix_dedup, "SHARE", share)
    rows = repeats(seed, 90)
    found = suffix_dedup.remove_repeats(frame(spark, rows, extra=True), length=40).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == dict(zip([r[0] for r in rows], brute_removal([r[1] for r in rows], 40), strict=True))


def prose(seed, n):
    """Texts that share strings of 380 to 900 bytes and passages of 45 to 60 words, once within a text."""
    rnd = random.Random(seed)
    words = lambda k: " ".join("".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(1, 9))) for _ in range(k))
    passages = [words(rnd.choice((45, 50, 51, 52, 55, 60, 120))) for _ in range(20)] + [words(400)[:k] for k in (390, 395, 399, 400, 405)]
    rows = [(k, " ".join([words(rnd.randint(0, 80)), *(f"{rnd.choice(passages)} {words(rnd.randint(0, 30))}" for _ in range(rnd.randint(0, 2)))]), "a") for k in range(n)]
    return [*rows, (n, " ".join([words(9), passages[0], words(5), passages[0]]), "a"), (n + 1, rows[3][1], "a"), (None, None, "a"), (None, rows[4][1], "a"), (7, rows[7][1], "a"), (n + 2, words(30_000), "a")]


def brute_passages(texts, k=51):
    """Whether a text has a run of k words that another row's text has."""
    runs = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in ((t or "").split() for t in texts)]
    seen = Counter(x for r in runs for x in r)
    return [any(seen[x] > 1 for x in r) for r in runs]


@pytest.mark.parametrize("share", [15, 20_000])
def test_removal_at_its_own_length_and_passages(spark, monkeypatch, share):
    monkeypatch.setattr(suffix_dedup, "SHARE", share)
    rows = prose(11, 120)
    texts = [t for _, t, _ in rows]
    found = suffix_dedup.digest(suffix_dedup.find_repeats(frame(spark, rows, extra=True))).collect()
    want = Counter((i, *b, h) for (i, _, _), b, h in zip(rows, brute_removal(texts, 400), brute_passages(texts), strict=True))
    assert Counter((*tuple(r)[:5], r["has_passage"]) for r in found) == want
    assert 20 < sum(h for *_, h in want) < 110 and any(not n and h for _, _, n, _, _, h in want)
    for r in found:
        assert sum(b - a for a, b in r["removed"]) == r["n_removed"]


def test_removal_does_not_depend_on_how_the_table_is_split(spark, tmp_path):
    rows = prose(12, 60)
    docs = stored(frame(spark, rows).repartition(7), tmp_path)
    want = Counter(map(str, suffix_dedup.remove_repeats(docs).collect()))
    found = suffix_dedup.remove_repeats(docs)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        assert Counter(map(str, found.collect())) == Counter(map(str, suffix_dedup.remove_repeats(docs).collect())) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_second_hash_tells_regular_strings_apart():
    a = np.array([k.bit_count() & 1 for k in range(4096)], np.uint8) + 97
    data = np.concatenate([a, 195 - a])
    starts = np.array([0, 4096])
    assert len(np.unique(suffix_dedup._Strings(data).hash(starts, starts + 4096, 1))) == 2


def test_removal_from_nothing(spark):
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0
    found = suffix_dedup.remove_repeats(frame(spark, [(1, "short", "a"), (2, "short", "a"), (3, None, "a")])).collect()
    assert all(r["n_removed"] == 0 for r in found)


def test_loser_tree_merges_front_coded_runs():
    rnd = random.Random(8)
    runs = []
    for r in range(7):
        run = sorted(("".join(rnd.choice("ab") for _ in range(12)).encode(), r, k) for k in range(rnd.randint(0, 30)))
        runs.append(run)
    coded = [suffix_dedup.front_decode(suffix_dedup.front_code(r)) for r in runs]
    merged = list(suffix_dedup.LoserTree(coded))
    assert [m[:3] for m in merged] == sorted(x for r in runs for x in r)
    for (a, *_), (b, _, _, h) in zip(merged, merged[1:], strict=False):
        assert h == suffix_dedup.shared_prefix(a, b)


# 6


def test_packing(spark):
    docs = frame(spark, [*ODD, (50, "word, " * 7000, "a")], extra=True)
    rows = packing.pack_documents(docs).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    for i, text, _ in [*ODD, (50, "word, " * 7000, "a")]:
        ids = np.asarray([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        want = [(k, at, len(p := ids[at : at + 2048]), zlib.crc32(p.tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
        assert set(mine) == set(want)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == list(np.cumsum([0, *(n for _, n in p[:-1])])) and sum(n for _, n in p) <= 2048
    assert len(places) == packing.lower_bound(np.bincount([r["length"] for r in rows], minlength=2049), 2048)


def test_bound_never_exceeds_what_packing_needs():
    rnd = np.random.default_rng(1)
    for high in (20, 60, 100):
        for _ in range(30):
            sizes = rnd.integers(1, high + 1, rnd.integers(1, 60))
            bins, offsets, n = packing.best_fit_decreasing(sizes, 100)
            assert packing.lower_bound(np.bincount(sizes, minlength=101), 100) <= n
            assert np.bincount(bins, weights=sizes).max() <= 100


def test_packing_exchanges_between_pools(spark):
    rows = [(k, k, 0, 0, int(n), 0) for k, n in enumerate(np.random.default_rng(3).integers(1, 2048, 3000))]
    pieces = spark.createDataFrame(rows, "row long, doc_id long, piece int, start long, length long, ids_crc32 long")
    packed = packing.pack(pieces, pool=300).toPandas()
    fill = packed.groupby("sequence_id")["length"].sum()
    bound = packing.lower_bound(np.bincount(packed["length"], minlength=2049), 2048)
    alone = packing.pack(pieces, pool=300, rounds=1).select("sequence_id").distinct().count()
    assert len(packed) == 3000 and fill.max() <= 2048
    assert bound <= len(fill) < alone and len(fill) <= bound * 1.02


def test_word_ids_are_the_tokenizers():
    ids = packing._WordIds(packing.default_tokenizer())
    texts = ["İ, x", "Å% ǅ!", "don't it's 'll x_y_z a²b ²", "क़ं", "a1b2 3½.", "ｆｕｌｌ！", "İ̇..", "<|endoftext|> a", "x\x1fy\x85z\xa0w", "ﬁ. K", "ΑΣ. Word, WORD", "…a…"]
    for again in range(2):
        for t, found in zip(texts, ids.texts([textkit.encode(t) for t in texts]), strict=True):
            assert found.tolist() == ids.tokenizer.encode(t, add_special_tokens=False).ids
    assert ids.texts([b"", b" \n"])[0].tolist() == []


# 5


def test_mixing(spark):
    rnd = random.Random(2)
    rows = [(k, "w " * rnd.randint(0, 400), rnd.choice(["a", "b", "b", "b", "c", None])) for k in range(200)] + [(7, "x y", "a"), (None, None, "zero")]
    found = mixing.mix(frame(spark, rows, extra=True), block_tokens=64).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r["src"], []).append(r)
        assert r["taken"] <= 2 * r["size"]
    assert abs(sum(rs[0]["target"] for rs in by.values()) - 1.5 * sum(r["size"] for r in found)) < 1e-6
    for rs in by.values():
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 2 * 64
        assert rs[0]["target"] <= 2 * rs[0]["source_size"]
    again = mixing.mix(frame(spark, rows), block_tokens=64).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_schedule_is_even_at_every_prefix(spark):
    plan = spark.createDataFrame([(0, 500), (1, 300), (2, 5)], "src long, slots long")
    slots = mixing.schedule(plan, 805).toPandas().sort_values("slot")
    assert slots["slot"].tolist() == list(range(805))
    for src, n in ((0, 500), (1, 300), (2, 5)):
        mine = slots[slots["src"] == src]
        assert mine["rank"].tolist() == list(range(len(mine)))
        assert (abs((slots["src"] == src).cumsum() - (slots["slot"] + 1) * n / 805) < 4).all()


def test_another_schedule_gives_another_mix(spark, monkeypatch):
    docs = frame(spark, [(k, f"w{k} " * (20 + k % 60), "abcdefg"[k % 7]) for k in range(300)])
    taken = {r["doc_id"]: (r["taken"], r["first_slot"]) for r in mixing.mix(docs, block_tokens=16).collect()}
    monkeypatch.setattr(mixing, "GOLDEN", 0.123456)
    other = {r["doc_id"]: (r["taken"], r["first_slot"]) for r in mixing.mix(docs, block_tokens=16).collect()}
    assert sum(taken[k][0] != other[k][0] for k in taken) and sum(taken[k][1] != other[k][1] for k in taken) > 100


def test_mix_comes_in_slot_order(spark, tmp_path):
    docs = stored(frame(spark, [(k, f"w{k} " * (20 + k % 60), "abc"[k % 3]) for k in range(300)] + [(5, "same " * 20, "a")] * 3, extra=True), tmp_path)
    first = {r["doc_id"]: r["first_slot"] for r in mixing.mix(docs, block_tokens=16).collect() if r["doc_id"] != 5}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        rows = [r["doc_id"] for r in mixing.mixed(docs, block_tokens=16).collect() if r["doc_id"] != 5]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    came = list(dict.fromkeys(rows))
    assert [first[i] for i in came] == sorted(first[i] for i in came) and set(came) == {i for i, s in first.items() if s is not None}


def test_mixing_very_long_texts(spark):
    found = {r["doc_id"]: r for r in mixing.mix(frame(spark, [(1, LONG, "a"), (2, "x y z", "a"), (3, "b " * 70_000, "b")])).collect()}
    assert found[1]["size"] == 40_000 and found[3]["size"] == 70_000
    assert all(abs(found[i]["taken"] - found[i]["target"]) < 400 for i in (3,)) and all(r["taken"] <= 2 * r["size"] for r in found.values())


def test_mixing_nothing(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(frame(spark, [(1, "", "a"), (2, None, None)])).collect()] == [0, 0]


def test_mixed_rows(spark, tmp_path):
    docs = stored(frame(spark, [(k, f"d{k} " * 10, "ab"[k % 2]) for k in range(40)], extra=True), tmp_path)
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns
    got = Counter()
    for r in rows.collect():
        got[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert got == Counter({k: v for k, v in want.items() if v})


# 9


PAGES = [(1, "http://a", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "x\r\ny", "z" * 3_000_000), (6, "u", "z" * 3_000_000), (None, "n", "<p>é</p>")]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = str(tmp_path / "warc")
    index = warc.write_archives(warc.with_revisits(pages), folder).collect()
    rows = warc.read_archives(spark, folder).collect()
    assert len(rows) == len(index) == len(PAGES)
    html = {p: (h or "").encode() for p, _, h in PAGES}
    first = {1: None, 2: 1, 3: None, 4: 3, 5: None, 6: 5, None: 1}
    for r in rows:
        assert r["refers_to"] == first[r["page_id"]] and r["record_type"] == ("response" if first[r["page_id"]] is None else "revisit")
        assert r["payload_bytes"] == len(html[r["page_id"]]) and r["payload_digest"] == warc.payload_digest(html[r["page_id"]])
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == html[r["page_id"]]
    for e in index:
        headers, body = warc.read_record(folder, e["bundle"], e["frame_start"], e["frame_size"], e["offset"], e["length"])
        assert headers["WARC-Record-ID"] == f"<{e['record_id']}>"


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame(PAGES[:4], "page_id long, url string, html string")
    assert {r["record_type"] for r in warc.archive_and_read(pages, least=100).collect()} == {"response"}
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_bundle_is_plain_zstandard_with_a_seek_table():
    import zstandard

    table = warc.seek_table([(10, 20), (30, 40)])
    assert warc.read_seek_table(b"frames" + table) == [(10, 20), (30, 40)]
    data = zstandard.ZstdCompressor().compress(b"hello") + warc.seek_table([(14, 5)])
    assert zstandard.ZstdDecompressor().decompressobj().decompress(data) == b"hello"


# 4


def test_fingerprints(spark):
    rows = [(k, f"start {k} " + " ".join(f"w{(k * 7 + j) % 500}x" for j in range(60)), "a") for k in range(60)] + [(70, "same", "a"), (71, "same", "a"), (72, None, "a"), (73, "", "a"), (74, LONG, "a"), (74, "again", "a")]
    found = fingerprints.fingerprint_pairs(frame(spark, rows, extra=True)).collect()
    assert len(found) == len(rows)
    ordered = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (-r[0], r[1]))
    want = Counter()
    for k, (i, t) in enumerate(ordered):
        n = len(t) // 3
        nxt = ordered[(k + 1) % len(ordered)][1]
        want[(i, len(t), hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found) == want
    by = {r["doc_id"]: r for r in found}
    assert by[70]["fingerprint"] == by[71]["fingerprint"] and by[71]["near_next"] == 1.0
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    assert np.mean([r["near_edited"] for r in found if r["n_chars"] > 100]) > 0.35


def test_slices_are_counted_in_two_steps(spark):
    ids = [(k,) for k in (-5, 0, 1, 2, 3, 9, 10, 11, 55, 98, 99, 100, 1000)]
    docs = spark.createDataFrame(ids, "doc_id long")
    for cuts in ([], [7], list(range(0, 100, 3)), list(range(1, 101)), [5, 50]):
        found = docs.select("doc_id", fingerprints._slice(cuts).alias("s")).collect()
        assert [r["s"] for r in found] == [sum(c < i for c in cuts) for (i,) in ids]


def brute_fingerprint(text):
    """Chosen gram hashes and their likeness, from the tokens on."""
    tokens = re.findall(r"[^\x20\x09-\x0D]{1,4}[\x20\x09-\x0D]*|[\x20\x09-\x0D]+", text)
    grams = [tuple(tokens[k : k + 4]) for k in range(max(1, len(tokens) - 3))] if tokens else []
    return tokens, grams


def test_fingerprints_are_those_of_brute_force(spark):
    rnd = random.Random(21)
    words = ["stone", "a", "of", "bridges", "über", "x1", "mill"]
    rows = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40))), "a") for k in range(80)]
    df = fingerprints.with_fingerprint(frame(spark, rows), "text", "fp").collect()
    grams = {g for _, t, _ in rows for g in brute_fingerprint(t)[1]}
    schema = ", ".join(f"t{k} string" for k in range(4))
    hashed = spark.createDataFrame([tuple(list(g) + [None] * (4 - len(g))) for g in grams], schema)
    of = {tuple(x for x in r[:4] if x is not None): r[4] for r in hashed.select("*", F.hash("t0", "t1", "t2", "t3")).collect()}
    singles = spark.createDataFrame([(w,) for w in {x for _, t, _ in rows for x in brute_fingerprint(t)[0]}], "t string")
    single = {r[0]: r[1] for r in singles.select("t", F.hash("t")).collect()}
    for r in df:
        tokens, g = brute_fingerprint(r["text"])
        h = [of[x] for x in g]
        at = brute_winnow(h, fingerprints.WINDOW)
        assert r["fp_at"] == at and r["fp"] == [h[k] for k in at] + ([single[t] for t in tokens] if len(tokens) < fingerprints.SHORT else [])


def brute_winnow(h, w):
    n, out = len(h), set()
    for k in range(max(1, n - w + 1) if n else 0):
        window = list(enumerate(h[k : k + w], k))
        out.add(max((p for p, v in window if v == min(v for _, v in window))))
    return sorted(out)


def test_winnowing_takes_the_rightmost_smallest(spark):
    rnd = random.Random(6)
    lists = [[rnd.randint(0, 5) for _ in range(n)] for n in (0, 1, 2, 7, 8, 9, 30, 100)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(lists)], "k int, h array<int>")
    found = {r["k"]: r["p"] for r in df.select("k", fingerprints._winnowed(F.col("h")).alias("p")).collect()}
    assert found == {k: brute_winnow(v, fingerprints.WINDOW) for k, v in enumerate(lists)}


def test_fingerprints_of_nothing(spark):
    assert fingerprints.fingerprint_pairs(frame(spark, [])).count() == 0


# 3


def labelled(spark, n=300):
    rnd = random.Random(9)
    good = lambda: " ".join(rnd.choice("the of and stone river house light under bridge".split()) for _ in range(rnd.randint(3, 60))) + "."
    bad = lambda: " ".join(rnd.choice("STONE!! RIVER%% BUY$$ CLICK!!".split()) for _ in range(rnd.randint(3, 60)))
    rows = [(k, bad() if k % 6 == 0 else good(), "a") for k in range(n)]
    labels = spark.createDataFrame([(k, int(k % 6 != 0), 0) for k in range(0, n, 2)], "doc_id long, quality int, toxic int")
    return rows, labels


def test_quality(spark):
    rows, labels = labelled(spark)
    found = {r["doc_id"]: r["selected"] for r in quality.classify(frame(spark, rows, extra=True), labels).collect()}
    wrong = [k for k, s in found.items() if s != (k % 6 != 0)]
    assert len(found) == len(rows) and len(wrong) <= 3
    assert quality.classify(frame(spark, []), labels).count() == 0


def test_the_draw_decides(spark):
    rows, labels = labelled(spark)
    docs = frame(spark, rows)
    drawn = [{r["doc_id"]: r for r in quality.classify(docs, labels, seed=seed, evidence=0.5, margin=0.5).collect()} for seed in (1, 2)]
    chosen = [{i for i, r in d.items() if r["selected"]} for d in drawn]
    assert chosen[0] != chosen[1]
    for d, c in zip(drawn, chosen, strict=True):
        weights = sorted((r["log_weight"] for r in d.values()), reverse=True)
        assert c != {i for i, r in d.items() if r["log_weight"] >= weights[len(c) - 1]}
        assert min(d[i]["gumbel_key"] for i in c) > max(r["gumbel_key"] for i, r in d.items() if i not in c)
    assert sum(r["selected"] for r in quality.classify(docs, labels, k=77).collect()) == 77


def test_quality_on_odd_rows_and_without_labels(spark):
    rows, labels = labelled(spark)
    assert quality.classify(frame(spark, [*rows, *((1000 + (i or 0), t, s) for i, t, s in ODD)]), labels).count() == len(rows) + len(ODD)
    assert all(r["selected"] for r in quality.classify(frame(spark, rows[:20]), labels.limit(0)).collect())


def test_kept_rows_are_as_they_were(spark):
    rows, labels = labelled(spark)
    docs = frame(spark, rows, extra=True)
    left = quality.keep_good(docs, labels)
    assert left.columns == docs.columns and {r["log_weight"] for r in left.collect()} == {0.5}


def test_kth_largest(spark):
    values = [float(v) for v in np.random.default_rng(1).normal(size=500)] + [3.0, 3.0, -1e9]
    df = spark.createDataFrame([(v,) for v in values], "gumbel_key double")
    ordered = sorted(values, reverse=True)
    assert [quality.kth_largest(df, k) for k in (1, 7, 250, 503)] == [ordered[k - 1] for k in (1, 7, 250, 503)]


# 2


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav><!-- ad <p>x</p> -->
<div class="ad">Buy this now, it is very good for you and for all of us.</div><article><h1>Title &amp; more</h1><p><b>Lead.<br><p>First  paragraph
of text with an <a href="/y">inner link</a>.</p><ul><li>one<li>two</ul><div class="share">Share it</div></article>
<section id="comments"><p>I do not like this article at all, said a reader in a comment.</p></section><form><p>Sign up</p></form><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (3, "u", "<p>"), (None, "v", "plain text only, no tags at all in here")], "page_id long, url string, html string")
    rows = html_text.extract(pages).collect()
    assert rows[0]["text"] == "Title & more\n\nLead.\n\nFirst paragraph of text with an inner link.\n\none\n\ntwo"
    assert rows[0]["n_chars"] == len(rows[0]["text"])
    assert [r["text"] for r in rows[1:4]] == ["", "", ""]
    assert html_text.extract(pages.limit(0)).count() == 0


STORY = "<h1>The title of the story</h1><p>" + "The first paragraph is long enough to be read as text. " * 4 + "</p><p>" + "The second one goes on about the same thing. " * 4 + "</p>"


@pytest.mark.parametrize(
    "page",
    [
        f'<body><div class="layout has-sidebar"><article>{STORY}</article></div></body>',
        f'<body><div id="content" class="content no-sidebar">{STORY}</div></body>',
        f'<body><div class="post comments-enabled">{STORY}</div></body>',
        f'<body><div class="withSidebar">{STORY}</div></body>',
        f'<body><div class="sidebar-left"><div class="wrap"><main>{STORY}</main></div></div></body>',
        f'<body><main><h2>News</h2><div class="banner-wide"><article>{STORY}</article></div></main></body>',
    ],
)
def test_wrappers_with_aside_words_keep_the_article(page):
    other = '<div class="sidebar"><p>' + "Words of the side that are no article at all. " * 4 + "</p></div>"
    if "<article>" in page or "<main>" in page:
        other += '<div class="related"><article><p>' + "A teaser of another page that is not this article. " * 4 + "</p></article></div>"
    text = html_text.main_text(page.replace("</body>", other + "</body>"), html_text.grown_tree())[0]
    assert "The title of the story" in text and "first paragraph" in text and "second one" in text
    assert "no article at all" not in text and "teaser" not in text


LONGER = STORY + "<p>" + "A third paragraph brings the story to its end at last. " * 5 + "</p>"


@pytest.mark.parametrize(
    ("page", "wanted", "unwanted"),
    [
        (f'<div class="layout has-sidebar"><article>{STORY}</article></div>', ("title of the story", "second one"), ()),
        (f'<main><div class="widget-text">{STORY}</div></main>', ("title of the story", "second one"), ()),
        (f'<form id="aspnetForm"><div id="content">{STORY}</div><div class="footer">Imprint and contact</div></form>', ("title of the story", "second one"), ("Imprint",)),
        (f'<article>{STORY}<section class="search-rescue"><p>{"The search and rescue team went out. " * 5}</p></section></article>', ("title of the story", "rescue team"), ()),
        (f'<div id="text">{LONGER}</div><article><h3><a href="/o">Another story</a></h3><p>A teaser of another page that is not this one.</p></article>', ("title of the story", "third paragraph"), ("teaser",)),
        (f'<div id="content">{LONGER}</div><article><h3><a href="/o">Another story</a></h3><p>A teaser of another page that is not this one.</p></article>', ("title of the story", "third paragraph"), ("teaser",)),
        (f'<ul><li><a href="/">Home</a><li><a href="/n">News</a></ul>{LONGER}<ul><li><a href="/a">An older story of ours</a><li><a href="/b">One more</a></ul>', ("first paragraph", "third paragraph"), ("Home", "older story", "One more")),
        (f'<div class="cookie-banner"><p>We use cookies to make this site better for you and for us.</p></div><div class="entry-content">{STORY}</div><div class="related-items"><p>{"Other things to read. " * 6}</p></div>', ("first paragraph",), ("cookies", "Other things")),
        (f'<form action="/s"><p>Sign up for our letter and get one each week</p></form><article>{STORY}</article>', ("first paragraph",), ("Sign up",)),
    ],
)
def test_page_layouts(page, wanted, unwanted):
    text = html_text.main_text(f"<html><body>{page}</body></html>", html_text.grown_tree())[0]
    assert all(w in text for w in wanted) and not any(w in text for w in unwanted)


def _split_on(tree):
    return {html_text.FEATURES[tree.feature]} | _split_on(tree.low) | _split_on(tree.high) if tree.feature is not None else set()


def test_tree_splits_on_words_and_links_of_neighbours():
    used = _split_on(html_text.grown_tree())
    assert {"words", "link_density", "article", "article_elsewhere"} <= used and used & {"words_before", "words_behind"} and used & {"link_density_before", "link_density_behind"}


def test_html_of_long_pages_and_clashing_columns(spark):
    page = "<nav><a href='/'>Home</a></nav><article><p>One of very many paragraphs here.</p>" + ("<p>" + "word " * 40 + "</p>") * 20_000 + "</article>"
    pages = spark.createDataFrame([(1, "u", page, "x", 5), (1, "u", page, "y", 6)], "page_id long, url string, html string, text string, n_blocks int")
    rows = html_text.extract(pages).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0]["n_kept"] == 20_001 and rows[0]["text"].startswith("One of very many")


def test_tree_learns_its_table():
    rows = html_text.labelled_table()
    assert (html_text.grown_tree().predict(rows[:, :-1]) == (rows[:, -1] > 0)).all()


@pytest.mark.parametrize("page", ["<", "<p", "<<p>>", "</p></div>", "<script>", "<!-- open", "<p>a</p" * 50, "&#x110000; &#0; &bogus;", "<div " + "a" * 5000])
def test_broken_markup_does_not_fail(page):
    html_text.main_text(page, html_text.grown_tree())


# 1


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated files. The above copyright notice and this permission notice shall be included in all
copies. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""


def test_licenses(spark):
    rows = [(1, MIT, "a"), (2, "x\n// SPDX-License-Identifier: BSD-3-Clause\ny", "a"), (3, "Foo\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.", "a"), (4, None, "a"), (5, "", "a"), (6, LONG, "a")]
    rows += [(7, "This work is licensed under the GNU General Public License, version 3.", "a"), (8, "Licensed under the Apache License, Version 2.0.", "a"), (8, "A licence of its own kind.", "a")]
    found = licenses.scan(frame(spark, rows, extra=True)).collect()
    assert [r["licenses"] for r in found] == ["mit", "bsd-3-clause", "cc-by-nc-4.0,mit", "", "", "", "gpl-3", "apache-2.0", ""]
    assert found[-1]["n_unknown"] == 1
    assert licenses.scan(frame(spark, [])).count() == 0


#: A sentence for each identifier as SENTENCES has them.
KNOWN = (
    ("SPDX-License-Identifier: MIT", "spdx:mit"), ("Licensed under the Apache License, Version 2.0", "apache-header"),
    ("you may not use this file except in compliance with the License.", "apache-file"), ("You may obtain a copy of the License at", "apache-copy"),
    ('distributed under the License is distributed on an "AS IS" BASIS', "apache-basis"), ("See the License for the specific language governing permissions", "apache-limits"),
    ("Apache License 2", "apache-version"), ("GNU Affero General Public License v3", "agpl-3"), ("GNU Lesser General Public License v2.1", "lgpl-2.1"),
    ("This program is free software, you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl-free"),
    ("This program is distributed in the hope that it will be useful", "gpl-warranty"), ("You should have received a copy of the GNU General Public License", "gpl-copy"),
    ("without even the implied warranty of", "gpl-implied"), ("See the GNU General Public License for more details.", "gpl-see"),
    ("GNU General Public License, version 2", "gpl-2"), ("GNU General Public License", "gpl-any"), ("Mozilla Public License 2.0", "mpl-2.0"), ("Released under CC0 1.0.", "cc0"),
    ("CC BY-NC-SA 4.0", "cc-by-nc-sa-4.0"), ("CC BY-NC-ND 4.0", "cc-by-nc-nd-4.0"), ("CC BY-NC 4.0", "cc-by-nc-4.0"), ("Available under CC BY-SA 4.0.", "cc-by-sa-4.0"),
    ("CC BY-ND 4.0", "cc-by-nd-4.0"), ("CC BY 4.0", "cc-by-4.0"), ("Creative Commons Attribution", "cc-name"), ("Creative Commons Attribution-ShareAlike 4.0 International.", "cc-by-sa-4.0"),
    ("Creative Commons Attribution 4.0 International.", "cc-by-4.0"), ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit-grant"),
    ("The above copyright notice and this permission notice shall be included", "mit-notice"), ("MIT License", "mit-name"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc-grant"), ("ISC License", "isc-name"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd-grant"),
    ("Redistributions of source code must retain the above copyright notice", "bsd-source"), ("Redistributions in binary form must reproduce the above copyright notice", "bsd-binary"),
    ("may be used to endorse or promote products", "bsd-endorse"), ("All advertising materials mentioning features or use of this software must display", "bsd-advert"),
    ("BSD 3-Clause", "bsd-name-3"), ("BSD License", "bsd-any"), ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("placed in the public domain", "public-domain"), ("The software is provided as is", "warranty-as-is"), ("In no event shall we be liable", "no-liability"),
    ("All rights reserved", "rights-reserved"), ("Copyright 2020", "copyright"),
)


def test_no_known_sentence_is_filtered_out(spark):
    names = {n for n, _, _ in licenses.SENTENCES}
    assert names == {max((n for n in names if i == n or n[-1] in "-:" and i.startswith(n)), key=len) for _, i in KNOWN}
    found = licenses.scan(frame(spark, [(k, t, "a") for k, (t, _) in enumerate(KNOWN)])).orderBy("doc_id").collect()
    assert [r["sentence_ids"] for r in found] == [i for _, i in KNOWN]


#: What stands before the rest of a four-clause licence, its clauses and its end.
BSD = (
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n",
    "1. Redistributions of source code must retain the above copyright\n   notice, this list of conditions and the following disclaimer.\n",
    "2. Redistributions in binary form must reproduce the above copyright\n   notice, this list of conditions and the following disclaimer in the\n   documentation and/or other materials provided with the distribution.\n",
    "3. All advertising materials mentioning features or use of this software\n   must display the following acknowledgement:\n   This product includes software developed by the organization.\n",
    "4. Neither the name of the organization nor the names of its contributors\n   may be used to endorse or promote products derived from this software\n   without specific prior written permission.\n",
    "\nTHIS SOFTWARE IS PROVIDED BY THE AUTHOR ''AS IS'' AND ANY EXPRESS OR\nIMPLIED WARRANTIES ARE DISCLAIMED. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY DAMAGES.\n",
)


def flat(text):
    return text.replace("\n   ", " ")


def test_four_clauses_are_not_three(spark):
    rows = [(1, flat("".join(BSD)), "a"), (2, flat("".join(BSD[:3] + BSD[4:])), "a"), (3, flat("".join(BSD[:3] + BSD[5:])), "a")]
    rows += [(4, "Text released under CC0 1.0.", "a"), (5, "Some text. BSD 3-Clause", "a")]
    assert [r["licenses"] for r in licenses.scan(frame(spark, rows)).orderBy("doc_id").collect()] == ["bsd-4-clause", "bsd-3-clause", "bsd-2-clause", "cc0-1.0", "bsd-3"]


def gnu(thing, name, mark, before_either, version, lines=("", "")):
    return f"""This {thing} is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU {name}General Public{lines[0]}License as published by
the Free Software Foundation{before_either} either{lines[1]}version {version} of the License, or
(at your option) any later version.

This {thing} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
{name}General Public License for more details.

You should have received a copy of the GNU {name}General Public License
along with this {thing}; if not, write to the Free Software Foundation.
"""


NOTICES = {
    "gpl-2": gnu("program", "", ";", ";", "2", (" ", " ")),
    "gpl-3": gnu("program", "", ":", ",", "3", (" ", " ")),
    "lgpl-2.1": gnu("library", "Lesser ", ";", ";", "2.1", ("\n", "\n")),
    "agpl-3": gnu("program", "Affero ", ":", ",", "3", (" ", " ")),
    "bsd-2-clause": "".join(BSD[:3] + BSD[5:]),
    "bsd-3-clause": "".join(BSD[:3] + BSD[4:]),
    "bsd-4-clause": "".join(BSD),
}


def test_whole_notices_plain_indented_and_in_comments(spark):
    rows = []
    for name, text in NOTICES.items():
        lines = text.splitlines()
        forms = [text, "\n".join("    " + t for t in lines), "/*\n" + "\n".join(" * " + t for t in lines) + "\n */\nint x;", "\n".join("# " + t for t in lines), text.replace("\n", "\r\n")]
        rows += [(k, form, name) for k, form in enumerate(forms)]
    docs = spark.createDataFrame([(f"{s} {k}", t) for k, t, s in rows], "doc_id string, text string")
    found = {r["doc_id"]: r["licenses"] for r in licenses.scan(docs).collect()}
    assert found == {f"{s} {k}": s for k, _, s in rows}


# all


def test_shingles_are_those_of_words():
    raw = [textkit.encode(t, lower=True) for t in ("A b c d e f", "a B c d e f", "x", "", "a b c d e g")]
    h, first = textkit.shingles(raw, 5)
    sets = [set(h[first[k] : first[k + 1]].tolist()) for k in range(len(raw))]
    assert sets[0] == sets[1] and len(sets[0]) == 2 and len(sets[2]) == 1 and not sets[3] and len(sets[0] & sets[4]) == 1


def test_pipeline_stages(spark, tmp_path):
    rows, labels = labelled(spark)
    rows += [(1000, rows[1][1], "b"), (1001, rows[2][1].upper(), "b")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.toPandas()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == [f.name for f in frame(spark, []).schema]
    assert 1000 in set(seen["exact_copies"]["doc_id"]) and 1 not in set(seen["exact_copies"]["doc_id"])
    assert not set(seen["near_copies"]["doc_id"]) - set(seen["exact_copies"]["doc_id"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packed_sequences"])
