"""Every operator on nulls, empties, long texts, ties, repeated rows, clashing columns and an empty table, against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import audio, common, language_id, mixing, packing, quality_rules, seed_extend, signature_trees, sstable, suffix_dedup, tokens, tree_weighting

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    # names that the operators use themselves
    + [T.StructField(n, T.StringType()) for n in ("start", "score", "dup", "spans", "tokens", "media", "len", "word", "domain", "copies", "held", "hashes", "trusted", "root")]
)


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(["river", "stone", "maple", "harbour", "window", "quiet", "lantern", "thirty", "Orchard", "velvet"], n))


PASSAGE = prose(99, 70)
LONG = " ".join(f"{w}{i % 977}" for i, w in enumerate(prose(5, 9000).split()))


def documents() -> list[tuple[int | None, str | None]]:
    base = prose(1, 300)
    near = base.split()
    near[150] = "changed"
    return [
        (1, base),
        (2, base),
        (3, " ".join(near)),
        (4, prose(2, 120) + "\n" + PASSAGE + "\n" + prose(3, 90)),
        (5, prose(4, 60) + "\n" + PASSAGE + " tail"),
        (6, None),
        (7, ""),
        (8, " \t\n\x0b\x0c\r "),
        (9, "one"),
        (10, "one two"),
        (11, "ONE two"),
        (12, "x" * 5000),
        (13, "ab " * 4000),
        (14, LONG),
        (15, "é à ü — “quoted” 日本語 текст  nbsp  em 😀"),
        (16, "same line\nsame line\n\nsame line\n" + prose(6, 55)),
        (None, prose(7, 80)),
        (None, prose(7, 80)),
        (17, "twice " + prose(8, 70)),
        (17, "twice " + prose(8, 70)),
        (17, "another text under the same id " + prose(9, 70)),
        (18, "<|endoftext|> a  b   c <|endoftext|>"),
        (-5, prose(1, 40)),
        (19, "1234 5678 !!! ???"),
        (20, "nul\x00inside and \x1f control \x85 next"),
    ]


def frame(spark, rows=None):
    langs, sources = ["en", "fr", None, "de"], ["src0", "src1", None, "src12", "odd"]
    rows = documents() if rows is None else rows
    full = [(i, t, langs[k % 4], sources[k % 5], None, *["clash"] * 14) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def key(i):
    return common.NULL_ID if i is None else i


def ordered(rows):
    """Documents in the order of their identifiers, a null first, and of their texts."""
    return sorted(((i, t or "") for i, t in rows), key=lambda r: (key(r[0]), r[1]))


def multiset(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def test_audio(spark):
    got = multiset(audio.audio_features(frame(spark)), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    want = Counter()
    for i, t in documents():
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        want[i, len(b), len(p), sha(p), zlib.crc32(p[-64:])] += 1
    assert got == want


def test_audio_outputs(spark):
    rows = {r["doc_id"]: r for r in audio.audio_features(frame(spark), with_outputs=True).collect()}
    r = rows[14]
    samples, rate = audio.wav_samples(bytes(r["media"]))
    assert samples.rstrip(b"\0") == LONG.encode() and rate == audio.RATE
    with pa.ipc.open_stream(bytes(r["tensors"])) as reader:
        table = reader.read_all()
    assert table.schema.field("log_mel").type == audio.TENSOR and table.num_rows == r["n_tensors"]
    assert all(a < b for a, b in zip(table["start"].to_pylist(), table["stop"].to_pylist(), strict=True))
    assert sum(table["frames"].to_pylist()) == r["n_frames"]
    equal = [x["feature"] for x in audio.audio_features(frame(spark)).where("doc_id in (1, 2)").collect()]
    assert equal[0] == equal[1]


def brute_bytes(rows, length):
    seen, out = set(), Counter()
    done = set()
    for i, t in ordered(rows):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        fresh = set()
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen or w in fresh:
                gone[s : s + length] = True
            fresh.add(w)
        seen |= fresh
        done.add((i, t))
        runs = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out[i, len(b), int(gone.sum()), runs, sha(bytes(np.frombuffer(b, np.uint8)[~gone]))] += 1
    return out


def test_suffix_dedup(spark):
    got = suffix_dedup.remove_repeats(frame(spark))
    assert multiset(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(documents(), 100)


def test_suffix_dedup_other_length_and_text(spark):
    rows = [(k, prose(k % 3, 60 + k)) for k in range(30)]
    got = suffix_dedup.remove_repeats(frame(spark, rows), 40, keep=("lang",))
    assert multiset(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows, 40)
    assert all(sha(r["text"].encode()) == r["kept_sha256"] for r in got.collect())


def test_suffix_dedup_hot_anchor(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup.repeats, "HOT", 3)
    rows = [(k, prose(200 + k, 30) + " " + PASSAGE + " " + prose(300 + k, 30 + k)) for k in range(40)]
    got = suffix_dedup.remove_repeats(frame(spark, rows))
    assert multiset(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows, 100)


def test_packing(spark):
    pieces = packing.pack_documents(frame(spark), with_ids=True).collect()
    code = tokens.encoder(tokens.default_tokenizer()).tokenizer
    want = Counter((i, tuple(code.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in documents())
    by_doc: dict = {}
    for p in pieces:
        assert zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] and len(p["ids"]) == p["length"]
        by_doc.setdefault((key(p["doc_id"]), p["doc_tokens"]), []).append(p)
    assert sum(p["length"] for p in pieces) == sum(len(ids) * n for (_, ids), n in want.items())
    single = {key(i): ids for (i, ids), n in want.items() if n == 1 and sum(m for (j, _), m in want.items() if j == i) == 1}
    for (i, _), own in by_doc.items():
        if i in single:
            own.sort(key=lambda p: p["start"])
            assert tuple(x for p in own for x in p["ids"]) == single[i]
            assert [p["start"] for p in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))]
    sequences: dict = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))]
        total = sum(p["length"] for p in own)
        assert total <= 2048 and total & (total - 1) == 0 == total - own[0]["sequence_length"]


@pytest.mark.parametrize("lengths", [[], [1], [2048], [2049, 1, 3], [300] * 50, list(range(1, 400)), [5000, 256, 255, 1025, 513]])
def test_pack_places_every_id_once(lengths):
    placed = packing.pack(lengths)
    pieces = sorted((d, s, n) for _, window in placed for d, s, n in window)
    for doc, total in enumerate(lengths):
        at = 0
        for _, s, n in (p for p in pieces if p[0] == doc):
            assert s == at and n > 0
            at += n
        assert at == total
    assert all(sum(n for _, _, n in w) == size for size, w in placed)


def brute_shingles(t, n):
    w = WORD.findall(t.translate(LOWER))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_roots(rows, n, num, den):
    """(documents in order, their sets, the first document of each one's class)."""
    docs = ordered(rows)
    sets = [brute_shingles(t, n) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return docs, sets, [find(k) for k in range(len(docs))]


def brute_classes(rows, n, num, den):
    docs, sets, roots = brute_roots(rows, n, num, den)
    return Counter((docs[k][0], len(sets[k]), docs[roots[k]][0]) for k in range(len(docs)))


@pytest.mark.parametrize(("words", "num", "den"), [(3, 9, 10), (5, 4, 5), (2, 1, 2)])
def test_signature_trees(spark, words, num, den):
    from fractions import Fraction

    rows = documents()
    for k in range(25):  # a chain of near copies
        w = prose(50, 200).split()
        for j in range(k):
            w[(j * 7) % 200] = f"edit{j}"
        rows.append((100 + k, " ".join(w)))
    found = signature_trees.similarity_classes(frame(spark, rows), words, Fraction(num, den))
    got = found.select(common.original_id().alias("doc_id"), "n_shingles", common.original_id("component_id").alias("component_id"))
    assert multiset(got, "doc_id", "n_shingles", "component_id") == brute_classes(rows, words, num, den)


def test_signature_trees_in_chunks(spark, monkeypatch):
    """A bucket that is cut into chunks gives the same classes."""
    monkeypatch.setattr(signature_trees, "CHUNK_SHINGLES", 900)
    rows = []
    for k in range(40):
        w = prose(60 + k % 3, 150).split()
        w[k % 150] = f"only{k}"
        rows.append((k, " ".join(w)))
    found = signature_trees.similarity_classes(frame(spark, rows))
    got = found.select(common.original_id().alias("doc_id"), "n_shingles", common.original_id("component_id").alias("component_id"))
    assert multiset(got, "doc_id", "n_shingles", "component_id") == brute_classes(rows, 3, 9, 10)


def test_blocking_loses_no_pair():
    """Sets at the threshold share a part key, whatever their sizes."""
    from fractions import Fraction

    rng = np.random.default_rng(3)
    for t in (Fraction(9, 10), Fraction(4, 5)):
        sizes = signature_trees.Sizes(t)
        for n in [1, 2, 4, 5, 8, 9, 10, 19, 20, 27, 40, 90, 200, 1000]:
            for _ in range(20):
                a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
                drop = int(rng.integers(0, int(len(a) * (1 - t)) + 1))
                b = np.sort(rng.permutation(a)[: len(a) - drop])
                extra = 0
                while Fraction(len(b), len(a) + extra + 1) >= t and rng.random() < 0.8:
                    extra += 1
                b = np.sort(np.concatenate([b, rng.integers(0, 2**63, extra, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
                if Fraction(len(np.intersect1d(a, b)), len(np.union1d(a, b))) >= t:
                    x, y = ({(g, k): slack for g, slack, keys in signature_trees.part_keys(s, sizes) for k in keys.tolist()} for s in (a, b))
                    shared = [k for k in x if k in y]
                    groups = {g for g, _ in shared}
                    # in some group they agree in as many parts as either's slack says
                    assert any(sum(h == g for h, _ in shared) >= max(v for d in (x, y) for (h, _), v in d.items() if h == g) for g in groups), (n, len(a), len(b))


def brute_words(rows, length):
    seen, out = set(), Counter()
    for i, t in ordered(rows):
        w = WORD.findall(t)
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            g = tuple(w[s : s + length])
            if g in seen:
                gone[s : s + length] = [True] * length
            seen.add(g)
        kept = " ".join(x for x, y in zip(w, gone, strict=True) if not y)
        out[i, len(w), sum(gone), sha(kept.encode())] += 1
    return out


def test_seed_extend(spark):
    got = seed_extend.remove_repeats(frame(spark))
    assert multiset(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(documents(), 20)


def test_seed_extend_hot_anchor(spark, monkeypatch):
    monkeypatch.setattr(seed_extend.repeats, "HOT", 3)
    rows = [(k, prose(200 + k, 30) + " " + PASSAGE + " " + prose(300 + k, 30 + k)) for k in range(40)]
    got = seed_extend.remove_repeats(frame(spark, rows), 12)
    assert multiset(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(rows, 12)


def brute_base(t):
    w = WORD.findall(t)
    c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    trusted = spark.createDataFrame([(1,), (4,), (4,), (None,)], "doc_id long")
    found = quality_rules.judge(frame(spark), trusted)
    got = multiset(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = Counter()
    for i, t in documents():
        n, chars, symbols, lines, repeats = brute_base(t or "")
        want[i, n, chars, symbols, lines, repeats, n < 50 or 100 * repeats > 50 * n] += 1
    assert got == want
    assert all(not r["kept"] for r in found.collect() if r["base_failed"])


def test_quality_scores_by_hand(spark):
    """The score is the mean log ratio over words and pairs, in as many buckets as there are."""
    rows = [(1, "a b a"), (2, "c c"), (3, "a c")]
    found = quality_rules.judge(frame(spark, rows), spark.createDataFrame([(1,)], "doc_id long"), count=1 << 10)
    scores = {r["doc_id"]: r["score"] for r in found.collect()}
    grams = {i: t.split() + list(zip(t.split(), t.split()[1:], strict=False)) for i, t in rows}
    target, raw = Counter(grams[1]), Counter(g for v in grams.values() for g in v)
    t, r, b = sum(target.values()), sum(raw.values()), 1 << 10
    for i, own in grams.items():
        want = sum(np.log((target[g] + 1) / (t + b)) - np.log((raw[g] + 1) / (r + b)) for g in own) / len(own)
        assert scores[i] == pytest.approx(want, rel=1e-9)


def test_mixing(spark):
    df = frame(spark)
    taken = mixing.mix(df, max_epochs=2, share=(3, 2)).collect()
    every = Counter()
    for r in df.collect():
        leaf = (domain(r["source"] or "unknown"), r["lang"] or "unknown", r["source"] or "unknown")
        every[leaf] += len(WORD.findall(r["text"] or ""))
    total = sum(every.values())
    given = Counter()
    for r in taken:
        given[r["domain"], r["language"], r["origin"]] += r["tokens"] * r["copies"] + r["cut_tokens"]
    assert sum(given.values()) == total * 3 // 2
    assert all(given[k] <= 2 * every[k] for k in given)
    want = budgets(every, total * 3 // 2, 2)
    assert {k: v for k, v in given.items() if v} == {k: v for k, v in want.items() if v}


def domain(source):
    m = re.search("([0-9]{1,9})$", source)
    return "other" if not m else ("web", "books", "code")[int(m[1]) % 3]


def budgets(every, budget, epochs):
    """Water-filling by hand: full children leave, the rest is shared again."""

    def share(children, budget):
        out, live = {}, dict(children)
        while live:
            w = sum(x for x, _ in live.values())
            full = {k for k, (x, cap) in live.items() if cap * w <= budget * x}
            if not full:
                at = before = 0
                for k in sorted(live):
                    at += live[k][0]
                    out[k] = budget * at // w - before
                    before = budget * at // w
                return out
            first = min(full, key=lambda k: (live[k][1] / live[k][0], k))
            out[first] = live[first][1]
            budget -= live.pop(first)[1]
        return out

    weight = lambda path: mixing.WEIGHTS.get("/".join(path), 1)

    def down(prefix, budget):
        kids = sorted({k[: len(prefix) + 1] for k in every if k[: len(prefix)] == prefix})
        caps = {k[-1]: (weight(k), epochs * sum(v for x, v in every.items() if x[: len(k)] == k)) for k in kids}
        out = {}
        for name, b in share(caps, budget).items():
            path = (*prefix, name)
            out |= {path: b} if len(path) == 3 else down(path, b)
        return out

    return down((), min(budget, epochs * sum(every.values())))


def test_language_id(spark):
    rng = np.random.default_rng(0)
    make = lambda letters, n: " ".join("".join(rng.choice(list(letters), int(rng.integers(2, 8)))) for _ in range(n))
    teach = [(k, make("abcde", 60), "aa") for k in range(40)] + [(k, make("vwxyz", 60), "zz") for k in range(40)]
    teachers = spark.createDataFrame([*teach, (99, None, "aa"), (98, "text", None)], "id long, text string, lang string")
    found = {(r["doc_id"], r["lang_pred"], r["rejected"]) for r in language_id.identify(frame(spark), teachers.select("text", "lang")).collect()}
    by_id = {i: lang for i, lang, _ in found}
    assert by_id[6] == by_id[7] == by_id[8] == by_id[19] == "und"
    assert by_id[13] == "aa" and set(by_id.values()) <= {"aa", "zz", "und"}
    assert all(rejected for i, lang, rejected in found if lang == "und")
    test = spark.createDataFrame([(k, make("abcde" if k % 2 else "vwxyz", 12)) for k in range(60)], "doc_id long, text string")
    right = [r["lang_pred"] == ("aa" if r["doc_id"] % 2 else "zz") and 0 <= r["score"] <= 1 and not r["rejected"] for r in language_id.identify(test, teachers).collect()]
    assert sum(right) >= 58
    strange = spark.createDataFrame([(1, make("mnopq", 60))], "doc_id long, text string")
    assert language_id.identify(strange, teachers).first()["rejected"]
    nothing = language_id.identify(test, teachers.where("id < 0")).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_sstable(spark):
    folder = common.scratch(spark, "sst-test")
    manifest = sstable.write_shards(frame(spark), folder)
    got = sstable.read_shards(manifest).collect()
    code = tokens.encoder(tokens.default_tokenizer()).tokenizer
    want, at = [], 0
    for i, t in ordered(documents()):
        ids = [*code.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    shards = [sstable.open_shard(r["path"]) for r in manifest.collect()]
    for i, t in ((14, LONG), (9, "one"), (None, documents()[16][1])):
        hits = [x for x in (s.lookup(i) for s in shards) if x is not None]
        assert len(hits) == 1 and hits[0].tolist() == [*code.encode(t, add_special_tokens=False).ids, 0]
    assert all(s.lookup(12345) is None for s in shards)


@pytest.mark.parametrize("text", ["", " ", "a  b", " a", "a ", "don't we've I'll", "x  y", "é é", "  a b", "tab\t a", "日本 語", "<|endoftext|>x <|endoftext|> y", "1 2 33 444", "a\n b \n c", "​ zero", "ß\u0085 x", "😀 😀 a"])
def test_tokens_equal_the_library(text):
    code = tokens.Encoder(tokens.default_tokenizer())
    raw = np.frombuffer(text.encode(), np.uint8)
    ids, bounds = code.encode(raw, np.array([0, len(raw)]))
    assert ids.tolist() == code.tokenizer.encode(text, add_special_tokens=False).ids and bounds.tolist() == [0, len(ids)]


def test_tree_weighting_base(spark):
    held = F.coalesce(F.col("doc_id") % 4 == 0, F.lit(False))
    got = tree_weighting.score_documents(frame(spark), held).collect()
    counts: Counter = Counter()
    for i, t in documents():
        if not (i is not None and i % 4 == 0):
            counts.update(WORD.findall((t or "").translate(LOWER)))
            counts["\n"] += 1
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in documents():
        w = [*WORD.findall((t or "").translate(LOWER)), "\n"]
        base = sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        want[i, len(w), sum(counts[x] > 0 for x in w), n, round(base, 6)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def brute_ctw(train: list[bytes], text: bytes, depth: int) -> float:
    """Context-tree weighting by its definition: counts in dictionaries, weights by recursion."""
    from math import lgamma, log, pi

    count: dict = {}

    def places(raw):
        raw = raw.translate(bytes(textfold()))
        for k in range(len(raw) + 1):
            byte = raw[k] if k < len(raw) else 0
            context = (bytes(depth) + raw[:k])[-depth:]
            for j in range(8):
                yield context, (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1

    kids: dict = {}
    for raw in train:
        for context, node, bit in places(raw):
            for d in range(depth + 1):
                c = context[depth - d :]
                count.setdefault((c, node), [0, 0])[bit] += 1
                if d < depth:
                    kids.setdefault((c, node), set()).add(context[depth - d - 1 :])

    def kt(a, b):
        return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - log(pi)

    memo: dict = {}

    def inner(c, node):
        return sum(weighted(x, node) for x in kids.get((c, node), ()))

    def weighted(c, node):
        if (c, node) not in memo:
            own = kt(*count.get((c, node), (0, 0)))
            memo[c, node] = own if len(c) == depth else np.logaddexp(own, inner(c, node)) - log(2)
        return memo[c, node]

    total = 0.0
    for context, node, bit in places(text):
        p = None
        for d in range(depth, -1, -1):
            c = context[depth - d :]
            ab = count.get((c, node), (0, 0))
            own = (ab[bit] + 0.5) / (sum(ab) + 1)
            if p is None:
                p = own
            else:
                beta = np.exp(kt(*ab) - inner(c, node))
                p = (beta * own + p) / (beta + 1)
        total += np.log10(p)
    return total


def textfold():
    return [c + 32 if 65 <= c <= 90 else c for c in range(256)]


def test_tree_weighting_model(spark):
    rows = [(k, prose(k % 5, 4 + k % 3)[: 20 + k]) for k in range(12)]
    got = {r["doc_id"]: r["score"] for r in tree_weighting.score_documents(frame(spark, rows), F.col("doc_id") % 3 == 0).collect()}
    train = [t.encode() for k, t in rows if k % 3]
    for k, t in rows:
        assert got[k] == pytest.approx(brute_ctw(train, t.encode(), tree_weighting.DEPTH), rel=1e-5)


OPERATORS = {
    "audio": lambda d, s: audio.audio_features(d),
    "suffix": lambda d, s: suffix_dedup.remove_repeats(d),
    "packing": lambda d, s: packing.pack_documents(d),
    "trees": lambda d, s: signature_trees.similarity_classes(d),
    "seeds": lambda d, s: seed_extend.remove_repeats(d),
    "quality": lambda d, s: quality_rules.judge(d, d.select("doc_id")),
    "mixing": lambda d, s: mixing.mix(d),
    "language": lambda d, s: language_id.identify(d, d),
    "sstable": lambda d, s: sstable.read_shards(sstable.write_shards(d, common.scratch(s, "empty"))),
    "ctw": lambda d, s: tree_weighting.score_documents(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](frame(spark, []), spark).collect() == []


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_only_nulls(spark, name):
    found = OPERATORS[name](frame(spark, [(None, None), (None, None), (3, None)]), spark).collect()
    assert len(found) == (0 if name == "mixing" else 3)  # a leaf without tokens gives nothing


def test_native_plans_have_no_python(spark):
    for df in (quality_rules.judge(frame(spark), frame(spark).select("doc_id")), mixing.mix(frame(spark))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
