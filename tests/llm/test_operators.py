"""Each operator against a brute-force version, an exact round trip or the library, on rows with every oddity."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sievestone.llm import decontamination, license_scan, near_dedup, quality_rules, sentencepiece_codec, sharding, suffix_dedup, token_counts, token_output, url_filters
from sievestone.llm.textops import texts_of

from .rows import documents, frame

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def got(df) -> Counter:
    return Counter(map(tuple, df.collect()))


@cache
def library():
    return Tokenizer.from_file(BPE)


# --- urls
def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://a.NET/x", "http://net", "http://net/", "https://www.example.net/en/1?q", "https://example.net/en", "http://m.example.com/de/x#y", "http://example.com/en/", "http://xexample.com/de/", "ftp://ORG/fr/?", "http://a.b.c.d.e.org/fr/x", "x://y://z.net/a", "http://a.net/\nb"]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(3, urls[3], "h", "r")], "page_id long, url string, host string, rule string")

    def judged(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOW)
        fits = [(len(h + p), h + p, v) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    want = Counter((r["page_id"], *judged(r["url"])) for r in df.collect())
    assert got(url_filters.url_filter(df)) == want
    assert got(url_filters.url_filter(df.limit(0))) == Counter() and got(url_filters.url_filter(df, []).select("verdict").distinct()) == Counter([("allow",)])


# --- token files
def test_token_files(spark, tmp_path):
    df = frame(spark, [*documents(), (900, "<|endoftext|> in <|endoftext|>", *documents()[0][2:])])
    manifest, dictionary = token_output.write_tokens(df, BPE, str(tmp_path / "t"), shard_bytes=2000)
    rows = token_output.read_tokens(manifest, dictionary).collect()
    order = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, want = 0, []
    for d, t in order:
        ids = library().encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert Counter(map(tuple, rows)) == Counter(want) and manifest.count() > 1
    shard = token_output.Shard(manifest.orderBy("task", "number").first()["file"], dictionary)
    assert shard.ids(shard.docs - 1)[-1] == 2 and hashlib.sha256(dictionary).digest() == token_output.HEADER.unpack((tmp_path / "t" / manifest.first()["file"].rsplit("/", 1)[1]).read_bytes()[-token_output.HEADER.size :])[1]
    with pytest.raises(ValueError, match="another dictionary"):
        token_output.Shard(manifest.first()["file"], dictionary + b"x")
    alone = token_output.Shard(manifest.first()["file"])  # finds its dictionary by the hash
    assert [alone.ids(i).tolist() for i in range(alone.docs)] == [token_output.Shard(manifest.first()["file"], dictionary).ids(i).tolist() for i in range(alone.docs)]
    assert Counter(map(tuple, token_output.read_tokens(manifest).collect())) == Counter(want)
    empty, d = token_output.write_tokens(df.limit(0), BPE)
    assert token_output.read_tokens(empty, d).count() == 0


def test_pre_tokens_go_to_the_library_together():
    """The library gets few texts for many new pre-tokens, and the ids are its own, special strings and parts of them included."""
    texts = [*(f"word{i} <|x{i}|> |>endoftext<| Z{i}\n\n  \u00e9{i}'s" for i in range(400)), "<|", "|>", "<|endoftext", "a<|endoftext|>b", "", "<|<|endoftext|>|>"]
    e = token_output.Encoder(BPE)
    sent, real = [], e.pre.tokenizer

    class Counting:
        def encode_batch_fast(self, x, **options):
            sent.extend(x)
            return real.encode_batch_fast(x, **options)

        def __getattr__(self, name):
            return getattr(real, name)

    data = [t.encode() for t in texts]
    pre = e.pre
    e.pre = type("P", (), {"tokenizer": Counting(), "cut": pre.cut, "hashes": staticmethod(pre.hashes), "special": pre.special})()
    for _ in range(2):  # new words, then known ones
        ids, counts = e(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library().encode(t, add_special_tokens=False).ids for t in texts]
    assert len(e.known) > 20 * len(sent)
    e.mark = b""
    e._forget()
    ids, _ = e(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert ids.tolist() == [i for t in texts for i in library().encode(t, add_special_tokens=False).ids]


# --- licenses
def test_licenses(spark):
    texts = ["All rights reserved. CC-BY cc by", "general public license public general  PUBLIC\nlicense", "Released under the  MIT license!", "released under MIT", "cc by cc by", None, "", "Kcc by", "licensed under apache license version 2\nLicensed under CC BY-NC 4.0."]
    df = spark.createDataFrame([(i, t, "w") for i, t in enumerate(texts)] + [(0, texts[0], "w"), (None, texts[2], "w")], "doc_id long, text string, w string")
    sets = license_scan.template_sets(license_scan.TEMPLATES, 0.8)

    def scanned(t):
        words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s)
        low = (t or "").translate(LOW)
        w = words(low)
        at = [(i, label) for label, p in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        hits = [(len(set(words(line)) & set(x)) / len(x), label) for line in low.split("\n") for _, label, x, need in sets if len(set(words(line)) & set(x)) >= need]
        base = {label for _, label in at}
        return (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted(base)), ",".join(sorted(base | {x for _, x in hits})), 1.0 if base else max((x for x, _ in hits), default=0.0))

    assert got(license_scan.scan(df)) == Counter((r["doc_id"], *scanned(r["text"])) for r in df.collect())
    assert license_scan.scan(df.limit(0)).count() == 0 and license_scan.scan(df, templates=[]).count() == len(texts) + 2


# --- repeated passages
def passages(rows, w=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - w + 1):
            first[b[i : i + w]] = min(first.get(b[i : i + w], 1 << 63), (1 << 62) if d is None else d)
    out = Counter()
    for d, t in rows:
        b, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for i in range(len(b) - w + 1):
            if first[b[i : i + w]] < ((1 << 62) if d is None else d):
                gone[i : i + w] = b"\1" * w
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[(d, len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_passages(spark, monkeypatch):
    for name, value in (("CHUNK_BYTES", 4000), ("BUCKET_BYTES", 9000), ("BLOCK_BYTES", 1500)):
        monkeypatch.setattr(suffix_dedup, name, value)
    r = random.Random(4)
    near = [(500 + i, "".join(r.choice(["abc", "é", "xy"]) for _ in range(r.randrange(90))), *documents()[0][2:]) for i in range(40)]
    df = frame(spark, documents() + near)
    assert got(suffix_dedup.dedup(df)) == passages([(x[0], x[1]) for x in documents() + near])
    assert suffix_dedup.dedup(df.limit(0)).count() == 0
    kept = suffix_dedup.dedup(df, keep_text=True)
    assert kept.columns == df.columns and kept.count() == df.count() and kept.filter("text IS NULL").count() == 2


@pytest.mark.parametrize(("chunk", "bucket", "hot"), [(3000, 5000, 1), (20000, 9000, 3)])
def test_passages_of_hot_triggers_and_keys(spark, monkeypatch, chunk, bucket, hot):
    """One trigger with many phrases is dealt out by strings; a key with a third of the rows lies in many chunks."""
    for name, value in (("CHUNK_BYTES", chunk), ("RANGE_BYTES", 4 * chunk), ("BUCKET_BYTES", bucket)):
        monkeypatch.setattr(suffix_dedup, name, value)
    r = random.Random(8)
    make = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    core, sides = make(30), [make(40) for _ in range(6)]
    rows = [(None if i % 3 == 0 else i if i % 5 else i // 25, r.choice(sides)[r.randrange(30) :] + core + r.choice(sides)[: r.randrange(30)] + make(r.randrange(80))) for i in range(400)]
    rows += [(i, make(60) + rows[i][1]) for i in range(0, 60, 2)] + [(-5, rows[7][1]), (-5, rows[7][1])]
    assert got(suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot)) == passages(rows)


def test_chunks_of_a_range_go_as_one(spark, monkeypatch):
    """Rows between chunks and buckets are one for each unit and bucket at most, not one for each chunk and bucket."""
    for name, value in (("CHUNK_BYTES", 500), ("RANGE_BYTES", 4000), ("BUCKET_BYTES", 2000), ("UNITS", 2)):
        monkeypatch.setattr(suffix_dedup, name, value, raising=False)
    tables = {}
    monkeypatch.setattr(suffix_dedup, "materialize", lambda df, name, f=suffix_dedup.materialize: tables.setdefault(name, f(df, name)))
    r = random.Random(8)
    passage = ["".join(r.choice("abcdefgh") for _ in range(90)) for _ in range(12)]
    rows = [(i, "".join(r.choice("abcdefgh") for _ in range(60)) + "".join(r.sample(passage, 2))) for i in range(160)]
    found = got(suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == passages(rows)
    chunks = tables["chunks"].count()
    for name, kinds in (("known", 2), ("shared", 1)):
        assert tables[name].groupBy("bucket", "kind").count().agg({"count": "max"}).first()[0] <= chunks / 4, name


def test_order_of_suffixes():
    r = random.Random(9)
    data = np.frombuffer(("".join(r.choice("ab") for _ in range(3000)) + "a" * 200).encode(), np.uint8)
    start, rank = np.arange(3100), np.array([r.randrange(50) for _ in range(3100)])
    for window in (5, 8, 16, 50):
        order, new = suffix_dedup.ordered(data, start, rank, window)
        text = data.tobytes()
        keyed = [(text[i : i + window], int(rank[i])) for i in order]
        assert keyed == sorted(keyed) and new.tolist() == [k == 0 or keyed[k][0] != keyed[k - 1][0] for k in range(len(keyed))]


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_phrases_of_one_trigger_that_agree_in_half_of_their_hash(spark, monkeypatch, size):
    """Found among 400,000 random phrases around one trigger."""
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", size)
    texts = ["tnntnswhhphhdcnhviiotfcovuwnjvownplmlneuxbynnuojqf", "uwbintvszzgwhjfvviiotfcovuwnjvownnmedgjcilorjcjgor", "dptordolzcmxpjqziiiotfcovuwnjvownmsdamahtctqyuvvgc", "iucjwntmwlvqrtvjuiiotfcovuwnjvownihboioqutqnvtnttc"]
    _, _, _, trigger, full, _, _ = suffix_dedup.phrases(*texts_of(pa.array(texts)))
    assert len(trigger) == 4 and len(set(trigger.tolist())) == 1 and len(set(full.tolist())) == 4 and len({x >> 32 for x in full.tolist()}) == 2
    rows = list(enumerate([*texts, texts[0]]))
    assert got(suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == passages(rows)


# --- pieces
def test_pieces(spark):
    model, codec = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepiece_codec.codec(PIECES)
    r = random.Random(2)
    texts = [x[1] or "" for x in documents()] + ["日本語テキスト" * 30, " " * 200 + "b" * 200, "<s> 😀\x00é　x"] + ["".join(r.choice("  \n\taeintrhe日😀'<>") for _ in range(r.randrange(90))) for _ in range(300)]
    ids, counts = codec.encode(*texts_of(pa.array(texts)))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == model.encode(texts)
    df = frame(spark)
    one, again, other = (sentencepiece_codec.encode(df, PIECES, 0.3, seed) for seed in (1, 1, 2))
    assert one.columns == [*df.columns, "pieces"] and one.collect() == again.collect() != other.collect()
    for coded in (one, other):
        assert sentencepiece_codec.decode(coded, PIECES).filter("NOT decoded <=> coalesce(text, '')").count() == 0
    assert sentencepiece_codec.digest(df, PIECES).filter("lossless").count() == df.count() and sentencepiece_codec.digest(df.limit(0), PIECES).count() == 0


def test_agenda_is_the_lockstep():
    m, r = sentencepiece_codec.codec(PIECES), random.Random(7)
    words = [" " + "".join(r.choice("etaoinshrd") for _ in range(r.randrange(1, 30))) for _ in range(200)]
    symbols = [[int(m.char_id[ord("▁" if c == " " else c)]) for c in w] for w in words]
    size = np.array([len(s) for s in symbols])
    end, keys = np.cumsum(size), np.arange(200, dtype=np.uint64)
    ids, counts = m.merges.encode(np.concatenate(symbols), end - size, end, keys, 0.4)
    limit = int(0.4 * 2**64)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [m.merges.agenda(s, k, limit) for k, s in enumerate(symbols)]


# --- leaks
def test_leaks(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choices(words, k=r.randrange(5, 50)))) for i in range(25)] + [(100, None), (101, ""), (102, "one two")]
    docs, want = [], set()
    for d in range(150):
        i, text = items[r.randrange(25)]
        q = text.split()
        edits = int(0.2 * len(q) + 1e-9) if d % 3 else int(0.2 * len(q)) + 4
        for _ in range(edits):
            k = r.randrange(len(q))
            q[k : k + 1] = r.choice([[f"new{r.randrange(99)}"], [], [q[k], f"add{r.randrange(99)}"]])
            q = q or ["gone"]
        docs.append((d, ", ".join([*r.choices(words, k=30), *q, *r.choices(words, k=30)]).upper()))

    def nearest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [row[0] + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    for d, t in docs:
        for i, text in items[:25]:
            if nearest(text.split(), t.lower().split(", ")) <= int(0.2 * len(text.split()) + 1e-9):
                want.add((d, i))
    df = spark.createDataFrame([*docs, (900, None), (901, ""), (0, docs[0][1])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(x["doc_id"], x["item_id"]) for x in decontamination.leaks(df, bench).collect()}
    assert found <= want and len(found) >= 0.98 * len(want) > 50
    kept = {x["doc_id"] for x in decontamination.clean(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in found} | {900, 901}
    assert decontamination.leaks(df, bench.limit(0)).count() == 0 and decontamination.leaks(df.limit(0), bench).count() == 0


# --- counts
def test_counts(spark):
    r = random.Random(1)
    hard = ["'s 'll it's  it's\n\n  x", "''s", "don't've 'RE 're're", "x   ", "　　a 　b", " \n a", "é'é 12'34", "<|endoftext|> a<|endoftext|>", "日本語" * 50, "😀'm", "a\x85b"] + ["".join(r.choice("  \n\t'''srvelmdtx1!é　ll") for _ in range(r.randrange(14))) for _ in range(1500)]
    c = token_counts.counter(BPE)
    assert c(pa.array(hard))[1].tolist() == [len(e.ids) for e in library().encode_batch(hard, add_special_tokens=False)]
    df = frame(spark)
    want = Counter((x[0], len((x[1] or "").encode()), n := len(library().encode(x[1] or "", add_special_tokens=False).ids), n > 512) for x in documents())
    assert got(token_counts.token_counts(df, BPE)) == want and token_counts.token_counts(df.limit(0), BPE).count() == 0
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert got(token_counts.token_counts(df, PIECES).select("doc_id", "n_tokens")) == Counter((x[0], len(pieces.encode(x[1] or ""))) for x in documents())


# --- near duplicates
def groups(rows, k, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root, holders = list(range(len(rows))), defaultdict(list)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for x in s:
            holders[x].append(i)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("k", "percent", "node"), [(3, 85, 64), (3, 85, 8), (5, 80, 8)])
def test_near_duplicates(spark, monkeypatch, k, percent, node):
    monkeypatch.setattr(near_dedup, "NODE", node)
    if node == 8:  # a family of many such nodes goes through all levels: more trees for the same recall
        monkeypatch.setattr(near_dedup, "TREES", 14)
    rows = documents(seed=5, n=140)
    found = got(near_dedup.near_dups(frame(spark, rows), k, percent))
    want = groups([(x[0], x[1]) for x in rows], k, percent)
    want = Counter({(d, n, c, bool(same) or (d is None and c is None)): m for (d, n, c, same), m in want.items()})
    assert found == want


@pytest.mark.parametrize("columns", [64, 4096])
def test_bounds_of_a_family(columns, monkeypatch):
    """Members of a family that falls apart: bounds leave out none that is linked, and nearly all that aren't."""
    monkeypatch.setattr(near_dedup, "COLUMNS", columns)
    rng = np.random.default_rng(3)
    sets = [np.unique(np.concatenate([np.arange(120)[rng.random(120) > rng.choice([0.02, 0.2])], rng.integers(1000, 1100, 3)])).astype(np.uint64) for _ in range(80)]
    i, j = np.triu_indices(80, 1)
    shared = np.array([len(np.intersect1d(sets[x], sets[y])) for x, y in zip(i, j, strict=True)])
    linked = 100 * shared >= 85 * np.array([len(sets[x]) + len(sets[y]) for x, y in zip(i, j, strict=True)]) - 85 * shared
    kept = near_dedup._may_link(i, j, sets, 85, 100)
    assert linked.any() and not (linked & ~kept).any() and (columns < 120 or (kept & ~linked).sum() <= 0.05 * (~linked).sum())
    apart = [np.arange(x * 9, x * 9 + 9, dtype=np.uint64) for x in range(3)]
    assert not near_dedup._may_link(np.array([0, 0, 1]), np.array([1, 2, 2]), apart, 85, 100).any()


def test_near_duplicates_of_a_template(spark):
    """Pairs below the threshold that all share a template, with a near copy here and there: none is linked but those, and what
    is compared again grows with the documents, not with their pairs."""
    r = random.Random(1)
    base, rows = [f"w{r.randrange(5000)}" for _ in range(300)], []
    for i in range(160):
        rows.append((i, " ".join([*(f"x{i}_{j}" for j in range(36)), *base[36:]])))
    for i in range(0, 160, 10):
        words = rows[i][1].split(" ")
        words[150], words[-1] = f"z{i}", f"y{i}"
        rows.append((1000 + i, " ".join(words)))
    assert got(near_dedup.near_dups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)) == groups(rows, 3, 85)
    texts = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "v long, text string")
    prefixes = near_dedup._prefixed(texts.select("v", texts.v.alias("component")), texts, 3, 85, 100)
    met = [x["n"] for x in prefixes.groupBy("node").agg({"v": "count", "index": "max"}).filter("`max(index)`").withColumnRenamed("count(v)", "n").collect()]
    assert sum(n for n in met if n > 1) <= 40 * len(rows)


@pytest.mark.parametrize("part", [512, 7])
def test_classes_that_share_many_groups_are_compared_once(spark, monkeypatch, part):
    """Forty groups hold the same sixty classes or most of them, in a main component and many others: what goes on to be compared
    by texts is what sketches put near, from one group, and every pair that they put near is there."""
    monkeypatch.setattr(near_dedup, "PART", part)
    r = random.Random(4)
    component = {v: 0 if v < 30 else v for v in range(60)}
    members = [(g * 1009 - 20000, v, component[v]) for g in range(40) for v in range(60) if g % 2 or r.random() < 0.8]
    sketch = {v: bytes(r.randrange(256) for _ in range(32)) for v in range(60)}
    near = [(3, 40), (41, 42), (29, 59)]
    for a, b in near:
        sketch[b] = sketch[a]
    rows = spark.createDataFrame(members, "node long, v long, component long")
    classes = spark.createDataFrame([(v, 100, sketch[v]) for v in range(60)], "v long, n long, sketch binary")
    dealt = near_dedup._dealt(rows).collect()
    met = Counter()
    for block in {x["block"] for x in dealt}:
        here = [x for x in dealt if x["block"] == block]
        met.update((x["node"], x["v"], y["v"]) for x in here for y in here if x["v"] < y["v"] and x["component"] != y["component"] and (x["part"] != y["part"] or x["alone"]))
    held = defaultdict(set)
    for node, v, _ in members:
        held[node].add(v)
    assert met == Counter((node, a, b) for node, vs in held.items() for a in vs for b in vs if a < b and component[a] != component[b])
    found = near_dedup._proposed(rows, classes, 0.85).collect()
    together = {tuple(sorted(x["v"] for x in found if x["block"] == b)) for b in {x["block"] for x in found}}
    assert together == set(near)
    assert len(found) == 2 * len(near) and {(x["v"], x["component"]) for x in found} == {(v, component[v]) for p in near for v in p}


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_dups(frame(spark).limit(0)).count() == 0


# --- quality
def test_quality(spark):
    def stats(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        win = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {i + j for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover), failed

    rows = [*documents(), (700, "a b c a b c\n\na b c\n#x &", *documents()[0][2:])]
    out = quality_rules.quality(frame(spark, rows))
    assert got(out.drop("host_rejected", "kept")) == Counter((x[0], *stats(x[1])) for x in rows)
    assert out.filter("kept AND (base_failed OR host_rejected)").count() == 0 and quality_rules.quality(frame(spark, rows).limit(0)).count() == 0


def test_bad_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(80)), "too short"
    rows = [(i, bad if i < 195 else good, "bad.com") for i in range(200)] + [(200 + i, good if i % 10 else bad, "good.com") for i in range(200)] + [(400, good, "rare.com"), (401, bad, "rare2.com")]
    out = {r["doc_id"]: r for r in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[199]["host_rejected"] and not out[199]["kept"] and out[201]["kept"] and out[400]["kept"] and not out[401]["kept"]


def test_host_rates_by_hand(spark):
    """Thirty hosts with 2 failures in 20 documents, one with 14 in 20, one with 3 in 4: m = 0.1391, v = 0.0229."""
    rows = [(f"h{h}", i < 2) for h in range(30) for i in range(20)] + [("bad", i < 14) for i in range(20)] + [("few", i < 3) for i in range(4)]
    stats = spark.createDataFrame([(h, f, False, False) for h, f in rows], "source string, base_failed boolean, symbols_failed boolean, lines_failed boolean")
    rates = [0.1] * 30 + [0.7, 0.75]
    m = sum(rates) / 32
    v = sum((x - m) ** 2 for x in rates) / 32
    weight = max(1, m * (1 - m) / v - 1)
    bound = min(0.9, max(0.5, m + 3 * (m * (1 - m) / (weight + 1)) ** 0.5))
    shrunk = {"bad": (14 + m * weight) / (20 + weight), "few": (3 + m * weight) / (4 + weight), "h1": (2 + m * weight) / (20 + weight)}
    assert 0.139 < m < 0.14 and shrunk["few"] < bound < shrunk["bad"] < 0.7
    assert {x["host_key"] for x in quality_rules.host_verdicts(stats).filter("host_rejected").collect()} == {"bad"}


# --- shards
@pytest.mark.parametrize("limit", [300, 5000, 1 << 20])
def test_shards(spark, limit):
    rows = documents(n=120)
    out = sharding.shards(frame(spark, rows), limit).collect()
    assert Counter((r["doc_id"], r["n_bytes"]) for r in out) == Counter((x[0], len((x[1] or "").encode())) for x in rows)
    bits = lambda d: int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:15], 16)
    total = Counter()
    for d, n in ((x[0], len((x[1] or "").encode())) for x in rows):
        for depth in range(61):
            total[depth, bits(d) >> (60 - depth)] += n
    sums = Counter()
    for r in out:
        sums[r["depth"], r["shard"], r["part"]] += r["n_bytes"]
    for r in out:
        fits = [d for d in range(61) if total[d, bits(r["doc_id"]) >> (60 - d)] <= limit]
        assert r["depth"] == (fits[0] if fits else 60) and r["shard"] == bits(r["doc_id"]) >> (60 - r["depth"])
        assert sums[r["depth"], r["shard"], r["part"]] == r["shard_bytes"] and (r["shard_bytes"] <= limit or r["shard_docs"] == 1)
    assert sharding.shards(frame(spark).limit(0), limit).count() == 0
