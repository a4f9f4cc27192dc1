"""The corpus operators against brute force, exact round trips and planted cases."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import _words, fingerprints, jaccard_join, license_scan, media, mixing, packing, sharding, substring_dedup, token_counts, toxicity

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


# ---- 1 mixing


def level_fill(sizes: dict, share: float, cap: float) -> dict:
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    left, capped = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in sizes if s not in capped]
        level = (left - sum(capped.values())) / max(1, sum(weights[s] for s in open_))
        over = [s for s in open_ if level * weights[s] >= cap * sizes[s]]
        if not over:
            return {s: capped.get(s, level * weights[s]) for s in sizes}
        capped |= {s: cap * sizes[s] for s in over}


def test_mix_takes_each_target(docs, rows):
    sized = mixing.sized(docs)
    mixed = [r.asDict() for r in mixing.apply_plan(sized, mixing.mixture_plan(sized)).collect()]
    assert len(mixed) == len(rows)
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(words_of(text))
    targets, taken = level_fill(sizes, 1.5, 2), Counter()
    for r in mixed:
        assert r["copies"] <= 2 and r["_mix_source_size"] == sizes[r["source"]] and r["_mix_target"] == pytest.approx(targets[r["source"]])
        taken[r["source"]] += r["copies"] * r["size"]
    largest = defaultdict(int)
    for r in mixed:
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in sizes)


def test_larger_budgets_nest(docs):
    kept = {}
    for share in (0.3, 0.6, 0.9):
        kept[share] = {(r["doc_id"], r["text"]) for r in mixing.mix_documents(docs, weights=(1,), share=share, max_repeat=1).where("text is not null and text <> ''").collect()}
    assert kept[0.3] < kept[0.6] < kept[0.9]


def test_mix_repeats_rows_and_keeps_columns(docs):
    clash = docs.withColumn("copies", F.lit(77)).withColumn("_mix_cut", F.lit("x")).withColumn("_row", F.lit(1))
    sized = mixing.sized(docs)
    planned = Counter()
    for r in mixing.apply_plan(sized, mixing.mixture_plan(sized, share=1.2, max_repeat=2)).collect():
        planned[r["doc_id"], r["size"]] += r["copies"]
    found = mixing.mix_documents(clash, share=1.2, max_repeat=2)
    assert found.columns == clash.columns and {r["copies"] for r in found.select("copies").distinct().collect()} == {77}
    assert Counter((r["doc_id"], r["size"]) for r in mixing.sized(found).collect()) == +planned


def test_mix_of_nothing(none):
    assert mixing.mix_documents(none).columns == none.columns and mixing.mix_documents(none).count() == 0


# ---- 2 sharding


def hilbert_of(cell: list[int], bits: int) -> int:
    """The curve's index by the usual transposition, one cell at a time."""
    x, n = list(cell), len(cell)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return int("".join(str(v >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def test_hilbert_index_walks_to_neighbours(spark):
    n, bits = 3, 3
    cells = spark.range(1 << n * bits).select(*[((F.col("id") / (1 << bits * i)).cast("long") % (1 << bits)).alias(f"x{i}") for i in range(n)])
    found = {tuple(r[:n]): r["h"] for r in cells.withColumn("h", sharding.hilbert_index([F.col(f"x{i}") for i in range(n)], bits)).collect()}
    assert all(h == hilbert_of(list(c), bits) for c, h in found.items())
    path = [c for c, _ in sorted(found.items(), key=lambda x: x[1])]
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(path, path[1:], strict=False))


def test_shards_are_even_and_prune(docs, rows):
    found = sharding.shard_rows(docs).cache()
    got = [r.asDict() for r in found.collect()]
    counts = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s])) for s in counts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    ordered = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in ordered] == sorted(r["curve"] for r in got)
    manifest = sharding.shard_ranges(found).collect()
    assert sum(r["n_rows"] for r in manifest) == len(rows)


def test_few_and_no_rows_shard(spark, none):
    assert sharding.shard_rows(none).count() == 0
    three = spark.createDataFrame([(1, "a", "en", "s", 1)] * 3, none.schema)
    assert sorted((r["shard"], r["slot"]) for r in sharding.shard_rows(three).collect()) == [(0, 0), (5, 0), (10, 0)]


def test_shards_are_written(spark, docs, rows, tmp_path):
    clash = docs.withColumn("shard", F.lit("own")).withColumn("slot", F.col("doc_id"))
    sharded = sharding.shard_rows(docs)
    sharding.write_shards(clash, sharded, str(tmp_path / "shards"))
    found = spark.read.parquet(str(tmp_path / "shards"))
    assert Counter((r["doc_id"], r["text"], r["slot"]) for r in found.collect()) == Counter((r[0], r[1], r[0]) for r in rows)
    assert {r["shard"] for r in found.select("shard").distinct().collect()} == {"own"}
    assert {r["shard_"]: r["count"] for r in found.groupBy("shard_").count().collect()} == {r["shard"]: r["count"] for r in sharded.groupBy("shard").count().collect()}


def test_far_ids_shard(spark, none):
    far = spark.createDataFrame([(-(2**63), "a", "en", "s", 1), (2**63 - 1, "b", "en", "s", 1), (None, "c", "en", "s", 1)], none.schema)
    assert sharding.shard_rows(far).count() == 3


# ---- 3 packing


def test_pieces_hold_the_tokenizers_ids(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    expected = Counter()
    for doc_id, text, *_ in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            expected[(doc_id, k // 2048, k, len(part), zlib.crc32(part.tobytes()))] += 1
    found = [tuple(r) for r in packing.pack(docs).collect()]
    assert Counter(r[:5] for r in found) == expected
    bins = defaultdict(list)
    for r in found:
        bins[r[5]].append((r[6], r[3]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(k[3] * n for k, n in expected.items()) // 2048) + 1


@pytest.mark.parametrize("text", ["don't stop. Go!! now...", "<|endoftext|> <|ENDOFTEXT|> a", "É,é. İ ΑΣ ﬁ ½² €5 a_b-c", "word.\nnext, 'tis x%%% 12ab", " \x0b\x1c\x85 z", "é a."])
def test_words_alone_give_the_same_ids(text):
    ids = packing.WordIds(None)
    assert ids.whole(text.encode()) == np.asarray(ids.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_fullest_is_the_best_subset():
    rng = np.random.default_rng(3)
    for _ in range(40):
        counts = np.zeros(41, np.int64)
        for length in rng.integers(1, 20, 6):
            counts[length] += 1
        pieces = [n for n in range(41) for _ in range(counts[n])]
        sums = {0}
        for p in pieces:
            sums |= {s + p for s in sums}
        chosen = packing.fullest(23, counts)
        assert all(counts[n] >= k for n, k in chosen) and sum(n * k for n, k in chosen) == max(s for s in sums if s <= 23)


def test_nothing_packs_into_nothing(none):
    assert packing.pack(none).count() == 0


# ---- 4 media


def test_pictures_hold_the_payload(docs, rows):
    found = media.read_media(media.encode_media(docs)).collect()
    expected = Counter()
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (576 if not raw else -len(raw) % 576)
        expected[(doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in found) == expected


def test_all_row_filters_are_undone():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (15, 24)).astype(np.uint8)
    kinds, lines = np.repeat(np.arange(5), 3).astype(np.uint8), np.zeros_like(image)
    for y in range(15):
        for x in range(24):
            a, b = (int(image[y, x - 1]) if x else 0), (int(image[y - 1, x]) if y else 0)
            c = int(image[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            lines[y, x] = (int(image[y, x]) - (0, a, b, (a + b) // 2, paeth)[kinds[y]]) & 255
    assert (media.unfilter(kinds, lines) == image).all()


def test_damage_is_seen():
    good = media.encode_png(media.payload_of(b"some text " * 300))
    assert media.decode_png(good).tobytes() == media.payload_of(b"some text " * 300)
    for at in (3, 20, len(good) // 2, len(good) - 5):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.decode_png(bytes(bad))


def test_near_pictures_have_near_hashes():
    rng = np.random.default_rng(8)
    shaded = lambda: bytes(np.repeat(rng.integers(32, 200, 40), 500).astype(np.uint8))
    h = lambda t: int.from_bytes(media.cosine_hash(media.decode_png(media.encode_png(media.payload_of(t)))))
    one, other = shaded(), shaded()
    assert (h(one) ^ h(one[:9000] + b"X" + one[9001:])).bit_count() <= 8 < (h(one) ^ h(other)).bit_count()


# ---- 5 substring dedup


@pytest.mark.parametrize("window", [13, 30])
def test_repeated_windows_go(docs, rows, window):
    first = {}
    key = lambda d: (d is None, d or 0)
    for doc_id, text, *_ in rows:
        ws = words_of(text)
        for p in range(len(ws) - window + 1):
            g = tuple(ws[p : p + window])
            first[g] = min(first.get(g, key(doc_id)), key(doc_id))
    expected = Counter()
    for doc_id, text, *_ in rows:
        ws = words_of(text)
        gone = set()
        for p in range(len(ws) - window + 1):
            if first[tuple(ws[p : p + window])] < key(doc_id):
                gone |= set(range(p, p + window))
        expected[(doc_id, len(ws), len(gone), b" ".join(w for i, w in enumerate(ws) if i not in gone).decode())] += 1
    extra = docs.withColumn("chunk", F.lit(1)).withColumn("kept", F.lit("x"))
    found = substring_dedup.remove_repeats(extra, window)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in found.collect()) == expected
    assert sum(k[2] for k in expected) > 0


def test_dedup_leaves_other_columns(docs, none):
    found = substring_dedup.dedup_texts(docs)
    assert found.columns == docs.columns
    same = {(r["doc_id"], r["text"]) for r in found.collect()} & {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert (401, "") in same and (400, None) in same
    assert substring_dedup.dedup_texts(none).count() == 0


def test_dedup_keeps_clashing_columns(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    texts = [(1, passage, 1, 2, 3, "k", 5), (2, f"x {passage} y", 4, 5, 6, "l", 7)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, chunk int, n_words int, n_removed int, kept string, _row int")
    found = substring_dedup.dedup_texts(frame)
    assert found.columns == frame.columns and [tuple(r) for r in found.orderBy("doc_id").collect()] == [texts[0], (2, "x y", 4, 5, 6, "l", 7)]
    assert substring_dedup.remove_repeats(frame).select("chunk", "n_words", "_row").orderBy("_row").collect()[1][:] == (4, 22, 7)
    assert substring_dedup.dedup_texts(frame.select("doc_id", "text")).count() == 2


def test_ladder_doubles():
    assert substring_dedup.ladder(13) == [7, 13] and substring_dedup.ladder(50) == [7, 13, 25, 50]
    for w in range(2, 200):
        lengths = substring_dedup.ladder(w)
        assert lengths[-1] == w and all(a < b <= 2 * a for a, b in zip(lengths, lengths[1:], strict=False))


# ---- 6 fingerprints


def test_fingerprints_follow_edits(docs, rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    unique = {r[0]: r[1] or "" for r in order if r[0] is not None and r[0] != 411}
    found = {r["doc_id"]: r for r in fingerprints.edited_prints(docs.where("doc_id is not null and doc_id <> 411")).collect()}
    ids = sorted(unique, reverse=True)
    for i, doc_id in enumerate(ids):
        text, following = unique[doc_id], unique[ids[(i + 1) % len(ids)]]
        m = len(text) // 3
        assert found[doc_id]["edited"] == text[: len(text) - m] + following[:m] and found[doc_id]["n_chars"] == len(text)


def test_fingerprint_rows_stay_whole(docs, rows, none):
    assert fingerprints.edited_prints(docs).count() == len(rows) and fingerprints.edited_prints(none).count() == 0
    twice = [r for r in fingerprints.edited_prints(docs).where("doc_id = 411").collect()]
    assert len(twice) == 2 and any(r["edited"] == "same row twice here now"[: 23 - 7] + "same row twice here now"[:7] for r in twice)


def test_fingerprints_are_homomorphic(spark):
    def of(*texts):
        return [r["p"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fingerprints.fingerprint(F.col("t")).alias("p")).collect()]

    ab, ba, a, b, c = of("one line\ntwo lines\n", "two lines\none line", "one line", "two lines", "three lines")
    assert ab == ba and ab != a
    table = spark.createDataFrame([(ab, a, b, c)], ["ab", "a", "b", "c"])
    sums = table.select(fingerprints.combined(F.col("a"), F.col("b")).alias("sum"), fingerprints.combined(F.col("ab"), F.col("b"), -1).alias("rest"), fingerprints.likeness(F.col("ab"), F.col("ab")).alias("same"), fingerprints.likeness(F.col("a"), F.col("c")).alias("other"), fingerprints.likeness(F.col("ab"), F.col("a")).alias("part")).first()
    assert sums["sum"] == ab and sums["rest"] == a and sums["same"] == 1.0 and sums["other"] < 0.35 < sums["part"] < 0.95


def test_fingerprints_of_many_pieces(spark):
    same, other = "a\n" * 100_000, "".join(f"{i}\n" for i in range(100_000))
    frame = spark.createDataFrame([(same, "a\n" * 65_536, other, other[:-6] + "new\n")], ["same", "part", "other", "edited"])
    p = {c: fingerprints.fingerprint(F.col(c)) for c in frame.columns}
    frame = frame.select(*[p[c].alias(c) for c in frame.columns])
    p = {c: F.col(c) for c in frame.columns}
    near = [fingerprints.likeness(p[a], p[b]).alias(a + "_" + b) for a, b in (("same", "same"), ("same", "part"), ("same", "other"), ("other", "edited"))]
    rest, both = fingerprints.combined(p["same"], p["part"], -1), fingerprints.combined(p["same"], p["part"])
    found = frame.select(*near, p["same"].alias("print"), fingerprints.as_text(p["same"]).alias("text"), (fingerprints.combined(rest, p["part"]) == p["same"]).alias("back"), both["n"].alias("n")).first()
    assert found["same_same"] == 1.0 and found["back"] and found["n"] == 165_536 and found["print"]["n"] == 100_000
    assert found["same_part"] == pytest.approx(1 - 34_464**2 / (100_000**2 + 65_536**2))
    assert found["same_other"] < 0.1 and found["other_edited"] > 0.99
    lanes = found["text"][64:]
    assert len(lanes) == 512 and {lanes[i : i + 4] for i in range(0, 512, 4)} == {"0000", f"{100_000 % 65_536:04x}"}


# ---- 7 token counts


def test_counts_follow_edits(docs, rows):
    counts = token_counts.PretokenCounts()
    found = token_counts.count_with_edits(docs.withColumn("edits", token_counts.sample_edits()).withColumn("n_tokens", F.lit("clash")))
    got = [r.asDict() for r in found.collect()]
    assert len(got) == len(rows)
    for r in got:
        text = r["text"] or ""
        assert r["n_tokens"] == len(counts.encoding.encode_ordinary(text))
        for e in r["edits"]:
            start, end = min(e["start"], len(text)), min(e["end"], len(text))
            text = text[:start] + e["replacement"] + text[max(start, end) :]
        assert r["edited_tokens"] == len(counts.encoding.encode_ordinary(text)) and r["edited_chars"] == len(text)
    long = next(r for r in got if r["doc_id"] == 407)
    assert long["reencoded"] < long["n_pretokens"] / 20


def test_random_edits_keep_the_sums():
    counts, rng = token_counts.PretokenCounts(), np.random.default_rng(5)
    parts = ["a", "B", " ", "  ", "\n", "'s", "'", "7", "é", ".", "!!", " foo", "\n\n "]
    pick = lambda n: "".join(parts[i] for i in rng.integers(0, len(parts), n))
    for _ in range(60):
        text = pick(rng.integers(0, 300))
        tree = token_counts.TokenTree(text, counts)
        for _ in range(8):
            start = int(rng.integers(0, len(text) + 1))
            end, new = min(len(text), start + int(rng.integers(0, 90))), pick(rng.integers(0, 6))
            tree.edit(start, end, new)
            text = text[:start] + new + text[end:]
            assert (tree.text(), tree.chars, tree.tokens) == (text, len(text), len(counts.encoding.encode_ordinary(text)))


# ---- 8 Jaccard join


def brute_components(rows: list[tuple]) -> list[tuple]:
    sets = []
    for _, text, *_ in rows:
        ws = words_of((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(s), least.get(find(i), r[0])) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def test_components_are_exact(docs, rows):
    found = jaccard_join.jaccard_components(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == Counter(brute_components(rows))


def test_chains_and_many_near_copies(spark):
    import random

    rng = random.Random(11)
    base, out = [f"w{i}" for i in range(100)], []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(100)] = f"x{rng.randrange(999)}"
        out.append((i, " ".join(words)))
    chain = [f"c{i}" for i in range(60)]
    for i in range(40):
        chain = [*chain[3:], *[f"d{i}-{k}" for k in range(3)]]
        out.append((1000 + i, " ".join(chain)))
    out = [(i, t, None, None, None) for i, t in out]
    frame = spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long")
    found = jaccard_join.jaccard_components(frame).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == Counter(brute_components(out))


@pytest.mark.parametrize("rounds", [False, True])
def test_components_of_links(spark, rounds):
    from tessera.llm import components

    pairs = [*((i, i + 1) for i in range(40)), (100, 90), (90, 95), (200, 201), (201, 201), (-5, 40)]
    links = spark.createDataFrame([(max(p), min(p)) for p in pairs if p[0] != p[1]], "u long, v long")
    found = components.in_rounds(links) if rounds else components.components(spark.createDataFrame(pairs, "a long, b long"))
    expected = {i: -5 for i in [*range(41), -5]} | {90: 90, 95: 90, 100: 90, 200: 200, 201: 200}
    assert sorted(map(tuple, found.collect())) == sorted(expected.items())
    assert components.components(links.limit(0).toDF("a", "b")).count() == 0


def test_no_documents_join(none):
    assert jaccard_join.jaccard_components(none).count() == 0


def test_bounds_never_rule_out_a_link():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 60)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, rng.integers(0, 9)).astype(np.uint64)]))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        linked = 100 * both >= 75 * (len(a) + len(b) - both)
        assert linked == (both >= jaccard_join.least_overlap(np.int64(len(a)), np.int64(len(b))))
        if linked:
            n, m = (np.array([len(x)]) for x in (a, b))
            assert len(np.intersect1d(a[: jaccard_join.prefix_length(n)[0]], b[: jaccard_join.prefix_length(m)[0]]))


def test_lookups_never_close_a_link():
    for a in range(1, 400):
        n = np.array([a])
        for b in range(1, a + 1):
            m, both = np.array([b]), int(jaccard_join.least_overlap(np.int64(a), np.int64(b)))
            if both > b:
                continue
            # The shared ones come last in both sets, so as few as possible are looked up.
            seen = min(int(jaccard_join.lookup_length(n)[0]) - (a - both), int(jaccard_join.lookup_length(m)[0]) - (b - both))
            assert seen >= max(1, int(jaccard_join.least_shared(n)[0]), int(jaccard_join.least_shared(m)[0])), (a, b)


def test_small_sets_link(spark):
    out = []
    for i in range(30):
        words = [f"v{i}x{k}" for k in range(8)]
        out += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-1] if i % 2 else words[1:]))]
    out = [(i, t, None, None, None) for i, t in out]
    frame = spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long")
    found = jaccard_join.jaccard_components(frame).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: i - i % 2 for i in range(60)}
    assert {r["n_shingles"] for r in found} == {3, 4}


def test_near_copies_meet_once():
    import pyarrow as pa

    def tiles(copies: int) -> pa.Table:
        """Near copies that share 30 shingles, each of which is a tile, and are in components of their own."""
        rng, out = np.random.default_rng(6), []
        shared = np.sort(rng.integers(1, 2**62, 30))
        signs = rng.integers(0, 2**63, jaccard_join.SIGNATURE).astype(np.uint64)
        for k, token in enumerate(shared.tolist()):
            before = [*shared[:k][::-1].tolist(), 0, 0, 0, 0][:4]
            for node in range(copies):
                own = signs ^ np.uint64(1 << node % 60)
                out.append((token, True, node, node, 300 + node % 3, k, own.tobytes(), np.array(before, np.int64).tobytes()))
        out.sort(key=lambda r: (r[0], r[4]))
        names = ["tile", "home", "node", "component", "n_shingles", "place", "signature", "before"]
        return pa.table(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)))

    for copies in (10, 50, 200):
        every = jaccard_join._compared(tiles(copies), copies)
        pairs = set(zip(every.column("a").to_pylist(), every.column("b").to_pylist(), strict=True))
        assert every.num_rows == len(pairs) == copies * (copies - 1) // 2
        nearest = jaccard_join._compared(tiles(copies), 0)
        assert nearest.num_rows <= copies
        assert set(nearest.column("a").to_pylist()) | set(nearest.column("b").to_pylist()) == set(range(copies))


# ---- 9 toxicity


def test_toxic_documents_stand_out(spark):
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(1500):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(["blorg", "Vexnar", "snib"]))
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs += [(9000, None), (9001, ""), (9001, "")]
    frame, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(frame, marks.where(~toxicity.held_out(F.col("doc_id"))))
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(frame.withColumn("score", F.lit("clash")), model).collect()}
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = np.mean([(scored[i] >= 0.5) == (i % 6 == 0) for i in held])
    assert right > 0.95 and 0 <= scored[9000] == scored[9001] < 0.5
    assert toxicity.score(frame.limit(0), model).count() == 0
    untrained = toxicity.train(frame, marks.limit(0))
    assert toxicity.score(frame, untrained).agg(F.max("score")).first()[0] == 0.0


def test_only_the_curve_has_a_bounded_sample(spark):
    marks = spark.range(8000).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("toxic"))
    roles = {r["role"]: r["count"] for r in toxicity.marked_labels(marks, 300).groupBy("role").count().collect()}
    assert sum(roles.values()) == 8000 and 5000 < roles[0] < 5700 and 150 < roles[1] < 450
    twice = marks.limit(3).union(marks.limit(3).withColumn("toxic", F.lit(1)))
    assert [r["toxic"] for r in toxicity.marked_labels(twice).collect()] == [1, 1, 1]


def test_likelihoods_match_plain_kneser_ney(spark):
    """log P(word | class) of interpolated Kneser-Ney with a shared base, counted in plain Python over all labelled rows that are counted."""
    import math
    import random

    rng = random.Random(9)
    texts = [(i, " ".join(rng.choice("a b c d e f g h".split()) + rng.choice(["", "x"]) for _ in range(rng.randrange(1, 30)))) for i in range(120)]
    frame, marks = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(i, i % 3 // 2) for i, _ in texts], "doc_id long, toxic int")
    model, roles = toxicity.train(frame, marks, least=1), {r["doc_id"]: r["role"] for r in toxicity.marked_labels(marks).collect()}
    pairs, documents = (Counter(), Counter()), Counter()
    for i, text in texts:
        words = text.split()
        documents.update(set(words))
        if roles[i] == 0:
            pairs[i % 3 // 2].update(zip(words, words[1:], strict=False))

    def chance(c: int, before: str | None, word: str) -> float:
        base = (documents[word] + 1) / (sum(documents.values()) + len(documents) + 1)
        continuation = Counter(w for _, w in pairs[c])
        p = (max(continuation[word] - 0.75, 0) + 0.75 * len(continuation) * base) / len(pairs[c])
        held = sum(n for (a, _), n in pairs[c].items() if a == before)
        return (max(pairs[c][before, word] - 0.75, 0) + 0.75 * len({w for a, w in pairs[c] if a == before}) * p) / held if held else p

    for _, text in texts[:40]:
        data = np.frombuffer(text.encode(), np.uint8)
        words, hashes = toxicity._words(data, np.array([0, len(data)]))
        found, plain = model.token_ratios(hashes, np.arange(len(hashes)) == 0), text.split()
        assert found == pytest.approx([math.log(chance(1, b, w) / chance(0, b, w)) for b, w in zip([None, *plain], plain, strict=False)])


# ---- 10 license scans


def test_licenses_are_found_where_they_stand(spark, docs, rows):
    mit = license_scan.TEMPLATES["MIT"]
    changed = mit.replace("free of charge", "without charge").replace("merge, publish", "merge and publish")
    plants = [(1, "é intro. " + changed + " outro"), (2, "Released under the MIT License."), (3, "Permission is hereby granted, free of charge, to you"), (4, "x " + license_scan.TEMPLATES["Apache-2.0 header"]), (5, None), (6, "")]
    found = {r["doc_id"]: r["matches"] for r in license_scan.scan(spark.createDataFrame(plants, "doc_id long, text string").withColumn("matches", F.lit(1))).collect()}
    (m,) = found[1]
    assert m["license"] == "MIT" and 0.9 < m["coverage"] < 1 and plants[0][1][m["char_start"] : m["char_end"]].startswith("Permission is") and plants[0][1][: m["char_end"]].endswith("IMPLIED")
    assert [(m["license"], m["coverage"]) for m in found[2]] == [("MIT notice", 1.0)] and found[3] == [] and found[5] == [] and found[6] == []
    assert [m["license"] for m in found[4]] == ["Apache-2.0 header"]
    assert license_scan.scan(docs).where(F.size("matches") > 0).count() == 0 and license_scan.scan(docs).count() == len(rows)


def test_neighbouring_and_split_licenses(spark):
    notice, mit = license_scan.TEMPLATES["MIT notice"], license_scan.TEMPLATES["MIT full text"].split()
    header = " ".join(f"header{i}" for i in range(20))
    plants = [(1, f"x. {notice}. Also, {notice}."), (2, f"{notice}. " * 7), (3, " ".join([*mit[:80], header, *mit[80:]])), (4, " ".join(mit[:60])), (5, " ".join(mit + mit))]
    frame = spark.createDataFrame(plants, "doc_id long, text string")
    found = {r["doc_id"]: [(m["license"], m["coverage"]) for m in r["matches"]] for r in license_scan.scan(frame).collect()}
    assert found == {1: [("MIT notice", 1.0)] * 2, 2: [("MIT notice", 1.0)] * 7, 3: [("MIT full text", 1.0)], 4: [], 5: [("MIT full text", 1.0)] * 2}
    ((license, coverage),) = [(m["license"], m["coverage"]) for r in license_scan.scan(frame.where("doc_id = 4"), least_coverage=0.3).collect() for m in r["matches"]]
    assert license == "MIT" and 0.5 < coverage < 0.75
    with pytest.raises(ValueError, match="fewer than"):
        license_scan.scan(frame, {"short": "two words"})


def test_licenses_of_one_family_are_told_apart(spark):
    whole = license_scan.TEMPLATES
    named = lambda head: next(t for n, t in whole.items() if n == head)
    bsd2, bsd3 = named("BSD-2-Clause full text").split(), named("BSD-3-Clause full text")
    ten = [f"inserted{i}" for i in range(10)]
    expected = {
        "Licensed under CC BY-SA 4.0": ["CC-BY-SA-4.0 notice"], "Licensed under CC BY-NC 4.0": ["CC-BY-NC-4.0 notice"], "Licensed under CC BY-ND 4.0": [], "Licensed under CC BY-NC 3.0": [],
        "Licensed under the GNU Lesser General Public License, version 2.1": ["LGPL-2.1 notice"], "licensed under GNU General Public License version 3": ["GPL-3.0 notice"],
        "Licensed under the GNU Library General Public License, version 2": [], "Licensed under the Apache License, Version 1.1": [], "Licensed under Apache License, Version 2.0": ["Apache-2.0 notice"],
        bsd3: ["BSD-3-Clause full text"], " ".join(bsd2): ["BSD-2-Clause full text"], " ".join([*bsd2[:68], *ten, *bsd2[68:]]): ["BSD-2-Clause full text"], " ".join([*bsd2[:40], *ten, *bsd2[40:]]): ["BSD-2-Clause full text"],
        named("LGPL-2.1-or-later header"): ["LGPL-2.1-or-later header"], named("GPL-3.0-or-later header").replace("version 3", "version 4"): [], named("AGPL-3.0-or-later header"): ["AGPL-3.0-or-later header"],
        named("MPL-2.0 header"): ["MPL-2.0 header"], named("MPL-2.0 header").replace("2.0", "1.1"): [], f"{bsd3} {whole['MIT full text']} {bsd3}": ["BSD-3-Clause full text", "MIT full text", "BSD-3-Clause full text"],
    }
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(expected)], "doc_id long, text string")
    found = {r["doc_id"]: r["matches"] for r in license_scan.scan(frame).collect()}
    assert {t: [m["license"] for m in found[i]] for i, t in enumerate(expected)} == expected
    assert all(m["coverage"] > 0.97 for i, t in enumerate(expected) if "inserted3" in t for m in found[i])


def test_chained_pieces_leave_a_second_copy_whole(spark):
    bsd = license_scan.TEMPLATES["BSD-2-Clause full text"].split()
    frame = spark.createDataFrame([(1, " ".join([*bsd[:110], *bsd]))], "doc_id long, text string")
    (matches,) = [r["matches"] for r in license_scan.scan(frame).collect()]
    assert [(m["license"], m["coverage"]) for m in matches] == [("BSD-2-Clause", 1.0), ("BSD-2-Clause full text", 1.0)]


def test_names_of_columns_in_other_cases(spark, docs, tmp_path):
    few = docs.where("doc_id < 20")
    for name in ("Score", "SCORE_"):
        frame = few.withColumn(name, F.lit("mine"))
        model = toxicity.train(few, few.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
        assert toxicity.score(frame, model, "score__").columns == [*frame.columns, "score__"]
    kept = substring_dedup.remove_repeats(few.withColumn("Kept", F.lit(1))).columns
    assert [c.lower() for c in kept].count("kept") == 1
    clash = few.withColumn("Shard", F.lit("mine"))
    sharding.write_shards(clash, sharding.shard_rows(clash, 2), str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert set(back.columns) == {*clash.columns, "shard_"} and back.where("Shard = 'mine'").count() == few.count()
    assert license_scan.scan(few.withColumn("Matches", F.lit(1))).columns == [*few.columns, "matches"]


def test_every_template_is_found_whole():
    index = license_scan.Index(license_scan.TEMPLATES)
    for name, text in license_scan.TEMPLATES.items():
        words = license_scan._words(f"some words {text} and more")
        grams = words.windows(license_scan.GRAM)[0]
        hits = [(t, at, own) for at in license_scan.winnow(words).tolist() for t, own in index.places.get(int(grams[at]), [])]
        ((t, coverage, matched, start, end),) = license_scan.matches_of(words.hash, hits, index)
        assert (index.names[t], coverage, matched, start, end) == (name, 1.0, len(index.words[t]), 2, 2 + len(index.words[t]))


def test_alignment_matches_the_full_table():
    rng = np.random.default_rng(4)
    for _ in range(40):
        template = rng.integers(0, 30, 20)
        words = np.concatenate([rng.integers(30, 60, 5), np.delete(template, rng.integers(0, 20, 2)), rng.integers(30, 60, 5)])
        score, best = np.zeros((21, len(words) + 1)), 0
        for i in range(20):
            for j in range(len(words)):
                score[i + 1, j + 1] = max(0, score[i, j] + (2 if template[i] == words[j] else -1), score[i, j + 1] - 1, score[i + 1, j] - 1)
        best = score.max()
        matched, start, end = license_scan.align(template, words, 5)
        assert matched >= (best + (end - start - matched)) / 2 - 1 and matched >= 17


# ---- shared helpers


def test_words_and_windows(rows):
    texts = [(r[1] or "").encode() for r in rows]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = _words.Words(np.frombuffer(b"".join(texts), np.uint8), bounds)
    flat = [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t)]
    assert found.text.tolist() == [i for i, _ in flat]
    names = {}
    for h, (_, w) in zip(found.hash.tolist(), flat, strict=True):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_long_words_that_differ_have_different_hashes():
    thue = "a"
    while len(thue) < 1024:
        thue += thue.translate(str.maketrans("ab", "ba"))
    for cut in (9, 16, 17, 64, 250, 256, 257, 1024):
        both = [thue[:cut], thue[:cut].translate(str.maketrans("ab", "ba")), thue[:cut].upper()]
        data = np.frombuffer(" ".join(both).encode(), np.uint8)
        assert len(set(_words.Words(data, np.array([0, len(data)])).hash.tolist())) == 3
        folded = _words.Words(data, np.array([0, len(data)]), fold=True).hash
        assert folded[0] == folded[2] != folded[1]


def test_small_accented_words_need_merges_alone():
    words = packing.WordIds(None)
    plain = words.tokenizer.encode
    latin = ["über", "straße", "ciónque", "ñ", "àéîõü", "ªº", "ÿ" * 40]
    wanted = {w: np.asarray(plain(w, add_special_tokens=False).ids, "<u4").tobytes() for w in [*latin, "Über", "ẞ", "é1", "e\u0301"]}
    words.tokenizer = None
    assert {w: words[w.encode()] for w in latin} == {w: wanted[w] for w in latin}
    words = packing.WordIds(None)
    assert {w: words[w.encode()] for w in wanted} == wanted
