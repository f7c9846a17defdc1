"""Each operator's method against a plain version of it, and the cases that every operator has to take."""

import collections
import html.parser
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from fringeflow.llm import decontaminate, fingerprint, jaccard_join, licenses, main_text, mixing, quality, text, token_store, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def thue_morse(n: int) -> tuple[str, str]:
    """Two words of 2 ** n letters whose polynomial hashes modulo 2 ** 64 agree for any odd base."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def hash_of(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(text.words(data, np.array([0, len(data)]))[0][0])


def test_words_without_algebra_between_them():
    for n in (10, 11, 12):
        a, b = thue_morse(n)
        assert hash_of(a) != hash_of(b)
    assert hash_of("ABC") == hash_of("abc") != hash_of("abc\0")
    rng = random.Random(1)
    words = {"".join(rng.choice("ab\0é") for _ in range(rng.randint(1, 40))) for _ in range(20_000)}
    assert len({hash_of(w) for w in words}) == len(words)


def test_words_that_polynomials_confuse(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_store.default_tokenizer())
    a, b = thue_morse(10)
    short = thue_morse(6)
    d = spark.createDataFrame(list(enumerate([a, b, *short, f"{a} x y z w v", f"{b} x y z w v", a + "."])), "doc_id long, text string").coalesce(1)
    token_store.write_store(d, f"file://{tmp_path}/s", token_store.default_tokenizer())
    got = {r.doc_id: r.ids_crc32 for r in token_store.read_digests(spark, f"file://{tmp_path}/s").collect()}
    for r in d.collect():
        ids = t.encode(r.text, add_special_tokens=False).ids + [1]
        assert got[r.doc_id] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
    assert {r.doc_id: r.component_id for r in jaccard_join.similar_groups(d).collect()} == {i: i for i in range(7)}
    bench = spark.createDataFrame([(1, f"{a} x y z w v")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.find_passages(d, bench).collect()] == [4]


def test_encoder_tells_words_of_one_hash_apart(monkeypatch):
    e = token_store.Encoder(token_store.default_tokenizer())
    texts = ["apple pear, plum.", "pear apple", "longer-word-than-eight other", "q" * 300 + " " + "r" * 300 + " apple"]
    data, offs = text.buffers(pa.array(texts))
    want, sizes = e.encode(data, offs)
    monkeypatch.setattr(text.Bytes, "hashes", lambda self, s, n: np.full(len(s), 77, np.uint64))
    e.reset()
    for _ in range(2):
        got, again = e.encode(data, offs)
        assert list(got) == list(want) and list(again) == list(sizes)


def near_copies(rng, words, groups, copies):
    rows = []
    for g in range(groups):
        base = [rng.choice(words) for _ in range(60)]
        for _ in range(copies):
            w = base[:]
            w[rng.randrange(60)] = "edit" + str(rng.randrange(9))
            rows.append(" ".join(w))
    return rows


def components(texts):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("how", [{}, {"hot": 2, "key_bits": 5, "dealt": 4}])
def test_jaccard_join_with_hot_groups(spark, monkeypatch, how):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    line = " ".join(f"c{i}" for i in range(30))
    rows = near_copies(rng, words, 3, 40) + [line + " " + " ".join(rng.choice(words) for _ in range(rng.choice((4, 40)))) for _ in range(60)] + [line] * 5
    how = dict(how)
    monkeypatch.setattr(jaccard_join, "DEALT", how.pop("dealt", 2000))
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_groups(d, **how).collect()}
    assert [got[i] for i in range(len(rows))] == components(rows)


def test_one_of_each_group_in_odd_tables(spark):
    t = " ".join(f"w{i}" for i in range(40))
    near, other, lone = t.replace("w20", "x"), " ".join(f"v{i}" for i in range(9)), "a b c"
    rows = [(1, t, 7), (1, other, 7), (1, t, 7), (2, near, 7), (None, near, 7), (None, lone, 8), (None, lone, 8), (3, None, 9), (3, None, 9), (4, " ", 9), (5, other, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, key long")
    got = sorted((str(r.doc_id), r.text or "", r.key) for r in jaccard_join.one_of_each_group(d).collect())
    assert got == sorted([("1", t, 7), ("1", other, 7), ("None", lone, 8), ("3", "", 9), ("3", "", 9), ("4", " ", 9)])
    assert jaccard_join.one_of_each_group(d.limit(0)).count() == 0
    wide = d.withColumnsRenamed({"key": "each"}).withColumns({"h": F.lit(1), "root": F.lit(2), "n": F.lit(3), "each_n": F.lit(4)})
    out = jaccard_join.one_of_each_group(wide)
    assert out.columns == wide.columns and out.count() == 6


# --- quality and toxicity ------------------------------------------------------------------------------------------
def letters(t):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode())


def byte_hash(word: bytes) -> int:
    return int(text.words(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0][0])


def plain_grade(m, t):
    """The score of a text, feature by feature."""
    raw = (t or "").encode()
    words = letters(t)
    per = collections.Counter(byte_hash(w) >> (64 - quality.BITS) for w in words)
    s = sum(m.weight[f] * np.float64(math.sqrt(k / len(words))) for f, k in per.items())
    all_words = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if x]
    n = max(len(raw), 1)
    count = lambda pattern: len(re.findall(pattern, raw, re.S)) / n
    low = lambda x: re.sub("[A-Z]", lambda c: c[0].lower(), x)
    blank = len(re.findall(rb"[\x20\x09-\x0D]", raw))
    shares = [
        count(rb"[A-Za-z]"), count(rb"[0-9]"), count(rb"[A-Z]"), count(rb"[\x80-\xff]"), blank / n, count(rb"[^0-9A-Za-z\x80-\xff]") - blank / n,
        len(set(map(low, all_words))) / max(1, len(all_words)), len(set(map(low, (re.sub(r"[\x09-\x0D ]", "_", x) for x in lines)))) / max(1, len(lines)), min(len(raw) / max(1, len(all_words)) / 20, 1),
        min(math.log1p(len(all_words)) / 12, 1), min(math.log1p(len(lines)) / 12, 1), min(len(all_words) / max(1, len(lines)) / 200, 1),
    ]
    for j, x in enumerate(shares):
        number = j * quality.STEPS + math.floor(math.sqrt(max(x, 0)) * (quality.STEPS - 1))
        f = int(text.mix(np.array([number + 0xABCDEF], np.uint64))[0]) >> (64 - quality.BITS)
        s += m.weight[f] * quality.HABITS**-0.5
    return s


def test_quality_against_plain_scores(spark):
    rng = random.Random(8)
    pool = ["Clear", "work", "spam", "click", "Été", "x1", "a-b", "END."]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice((1, 7, 50)))) + rng.choice(("", "\n", "\nmore lines\nmore lines"))) for i in range(80)]
    rows += [(90, None), (91, ""), (92, "long " * 30_000), (5, rows[5][1])]
    d = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, expected_grade string")
    m = quality.train(d, spark.createDataFrame([(i, i % 3) for i in range(80)], "doc_id long, grade int"))
    got = collections.defaultdict(list)
    for r in quality.grade(d, m, 2).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows) and len(got[5]) == 2
    for i, t in rows:
        s = plain_grade(m, t)
        tail = [1 / (1 + math.exp(-(s - th))) for th in m.threshold]
        for r in got[i]:
            assert r.expected_grade == pytest.approx(sum(tail), abs=1e-9) and r.tail_probability == pytest.approx(tail[1], abs=1e-9) and r.selected == (tail[1] >= 0.5)
    assert quality.grade(d.limit(0), m, 1).count() == 0


def test_quality_threshold_fit_is_the_likelihood():
    """With words that say nothing the thresholds are the grades' log odds; with two grades it is a logistic regression."""
    rows = [(g, np.array([3]), np.array([1.0])) for g in [0] * 30 + [1] * 50 + [2] * 20]
    m = quality.fit(rows, 200, 0.05, 0.0, 1)
    share = [m.tail(np.array([m.weight[3]]), k)[0] for k in (1, 2)]
    assert share == pytest.approx([0.7, 0.2], abs=0.03)


def plain_features(t):
    words = [re.sub(rb"[A-Z]", lambda x: x[0].lower(), w) for w in letters(t)]
    h = [byte_hash(w) for w in words]
    c = [int(x) for x in text.COMBINE]
    m = 2**64
    out = list(h)
    for a, b, salt in ((0, 1, 1), (0, 2, 2)):
        out += [(h[i + a] * c[salt] + h[i + b] * c[salt + 10]) % m for i in range(len(h) - b)]
    out += [(h[i] * c[3] + h[i + 1] * c[13] + h[i + 2] * c[23]) % m for i in range(len(h) - 2)]
    return {int(text.mix(np.array([x], np.uint64))[0]) >> (64 - toxicity.BITS) for x in out}


def plain_ftrl(rows, epochs, alpha, beta, l1, l2, seed):
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            y, f = rows[r]
            features = [*f, 1 << toxicity.BITS]
            w = {i: weight(i) for i in features}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in features:
                step = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - step * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z if weight(i)}


def test_toxicity_against_plain_scores(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((2, 9, 30)))) + rng.choice(("", ", Vile!", " éÉ")) for _ in range(120)]
    rows = [(i % 2, np.array(sorted(plain_features(t)))) for i, t in enumerate(texts)]
    m = toxicity.ftrl(rows, 3, 0.5, 1.0, 0.2, 1.0, 9)
    want = plain_ftrl([(y, list(map(int, f))) for y, f in rows], 3, 0.5, 1.0, 0.2, 1.0, 9)
    assert m.bias == pytest.approx(want.pop(1 << toxicity.BITS, 0.0))
    assert dict(zip(map(int, m.index), map(float, m.weight))) == pytest.approx(want)
    table = [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, "w1 w2 " * 50_000)]
    d = spark.createDataFrame([(*r, 1, 2) for r in table], "doc_id long, text string, score long, label long")
    got = {r.doc_id: r.score for r in toxicity.score(d, m).collect()}
    for i, t in table:
        s = m.bias + sum(want.get(f, 0.0) for f in plain_features(t if i != 502 else "w1 w2 w1 w2"))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-s)))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxic_scores(d.limit(0), none).count() == 0 and toxicity.without_toxic(d.limit(0), none).columns == d.columns


# --- url filter ----------------------------------------------------------------------------------------------------
def plain_url_score(model, host, path):
    w, b = model
    found = set()
    for kind, s in (("host", f"^{host}$"), ("path", f"^{path}$")):
        for n in url_filter.LENGTHS:
            for i in range(len(s) - n + 1):
                seed = xxhash.xxh64_intdigest(kind.encode(), 42)
                h = xxhash.xxh64_intdigest(s[i : i + n].encode(), seed)
                found.add((h - 2**64 if h >= 2**63 else h) % url_filter.DIMENSIONS)
    return 1 / (1 + math.exp(-(b + sum(w[f] for f in found) / math.sqrt(max(1, len(found))))))


@pytest.fixture(scope="module")
def url_model(spark):
    urls = spark.createDataFrame(url_filter.default_urls(), "url string, label int").withColumn("held", F.crc32(F.encode("url", "UTF-8")) % 5 == 0)
    return url_filter.train(urls.where("not held").drop("held")), urls.where("held")


def test_url_scores_against_plain_ones(spark, url_model):
    model, held = url_model
    urls = ["http://spam-farm.example.org/en/1", "http://a.b/", "", None, "http://x/é" + "yz" * 400]
    host, path = url_filter.parts(F.col("url"))
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", host.alias("h"), path.alias("p"), url_filter.score(host, path, model).alias("s")).collect()
    for r in rows:
        assert r.s == pytest.approx(plain_url_score(model, r.h, r.p))


def test_url_model_on_held_out_urls(spark, url_model):
    model, held = url_model
    host, path = url_filter.parts(F.col("url"))
    rows = held.select("label", url_filter.score(host, path, model).alias("s")).collect()
    assert sum((r.s >= 0.5) == (r.label == 1) for r in rows) > 0.92 * len(rows) > 200
    pages = spark.createDataFrame(
        [(None, "http://spam-farm.example.org/en/728"), (1, "http://www.cheap-pills.example.com/en/450?page=2"), (2, "https://blog.therti.example.org/en/334/"), (2, "https://news.example.com/en/4")],
        "page_id long, url string",
    )
    assert [r.verdict for r in url_filter.judge(pages).collect()] == ["block", "block", "allow", "allow"]


# --- token store, mixing, fingerprints -----------------------------------------------------------------------------
def test_token_store_of_odd_tables(spark, tmp_path):
    d = spark.createDataFrame([(3, "b c", 1), (3, "b c", 2), (1, None, 3), (None, "z", 4), (2, "word " * 40_000, 5)], "doc_id long, text string, start long")
    token_store.write_store(d, f"file://{tmp_path}/a", token_store.default_tokenizer())
    got = sorted(token_store.read_digests(spark, f"file://{tmp_path}/a").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 3] and got[3].ids_crc32 == got[4].ids_crc32
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(5)]
    token_store.write_store(d.limit(0), f"file://{tmp_path}/b", token_store.default_tokenizer())
    assert token_store.read_digests(spark, f"file://{tmp_path}/b").count() == 0


def test_expand_keeps_columns_of_any_name(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(1 + i % 9)), f"s{i % 3}", 7, 8, 9, 10, 11) for i in range(60)] + [(None, "x y", None, 7, 8, 9, 10, 11), (99, None, "s0", 7, 8, 9, 10, 11)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target int, source_size int, taken int, n_chars int")
    out = mixing.expand(d)
    assert out.columns == d.columns and out.dtypes == d.dtypes
    got = out.collect()
    assert {(r["size"], r.target, r.source_size, r.taken) for r in got} == {(7, 8, 9, 10)}
    taken = {r.doc_id: r.taken for r in mixing.mix_documents(d).collect()}
    words = collections.Counter()
    for r in got:
        words[r.doc_id] += len(r.text.split())
    assert {k: v for k, v in taken.items() if v} == dict(words)
    assert mixing.expand(d.limit(0)).count() == 0 and mixing.expand(d.withColumnRenamed("size", "part")).columns[3] == "part"


def test_fingerprints_of_odd_tables(spark):
    import hashlib

    rows = [(2, "b c d e f"), (2, "b c d e f"), (2, "q r"), (None, "n o"), (10**15, "last one"), (1, None), (-5, "long " * 20_000)]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, k_id int, near_next int")
    got = fingerprint.fingerprints(d).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in rows)
    # equal rows follow one another; the other row of that id stands before or after both
    texts = {r[0]: r[1] or "" for r in rows}
    order = [None, -5, 1, 2, 10**15]
    for a, b in zip(order, order[1:] + order[:1]):
        if 2 in (a, b):
            continue
        x, y = texts[a], texts[b]
        edited = x[: len(x) - len(x) // 2] + y[: len(x) // 2]
        assert [r.edited_sha256 for r in got if r.doc_id == a] == [hashlib.sha256(edited.encode()).hexdigest()]
    assert sorted(r.near_next for r in got if r.doc_id == 2).count(1.0) == 1
    one = fingerprint.fingerprints(d.where("doc_id = -5")).collect()
    assert one[0].near_next == 1.0 and one[0].near_edited > 0.9
    assert fingerprint.fingerprints(d.where("doc_id is null")).count() == 1 and fingerprint.fingerprints(d.limit(0)).count() == 0


# --- decontamination -----------------------------------------------------------------------------------------------
def some_items(rng, many, size=40):
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    return [" ".join(rng.choice(words) for _ in range(size)) for _ in range(many)]


def test_hamming_tables_hold_all_within_the_radius():
    rng = np.random.default_rng(3)
    part = decontaminate.Items(list(range(300)), some_items(random.Random(1), 300), [{}] * 300)
    prints = part.prints[rng.integers(0, 300, 400)].copy()
    for row, flips in zip(prints, rng.integers(0, decontaminate.RADIUS + 6, 400)):
        for bit in rng.choice(128, flips, replace=False):
            row[bit // 16] ^= np.uint16(1 << (bit % 16))
    window, item, _ = part.near(prints, 40)
    apart = np.bitwise_count(prints[:, None] ^ part.prints[None]).sum(2)
    assert set(zip(window.tolist(), item.tolist())) == set(zip(*map(list, (x.tolist() for x in np.nonzero(apart <= decontaminate.RADIUS)))))


def test_hamming_tables_select():
    """Windows of unlike text meet a small share of the items of their size."""
    rng = random.Random(2)
    part = decontaminate.Items(list(range(1000)), some_items(rng, 1000), [{}] * 1000)
    other = decontaminate.Items(list(range(500)), some_items(random.Random(77), 500), [{}] * 500)
    _, _, met = part.near(other.prints, 40)
    assert met < 0.12 * 500 * 1000


def test_recall_at_the_threshold():
    """Passages as far from their items as a similarity of 0.75 allows: five or six words in a row are others."""
    rng = random.Random(4)
    items = some_items(rng, 400)
    part = decontaminate.Items(list(range(400)), items, [{}] * 400)
    found = total = 0
    for i, t in enumerate(items):
        w = t.split()
        how = i % 3
        if how == 0:
            w[20] = "zzzz"
        elif how == 1:
            w[:5] = [f"z{j}" for j in range(5)]
        else:
            w[-3:], w[:2] = ["y1", "y2", "y3"], ["y4", "y5"]
        data, offs = text.buffers(pa.array([" ".join(w)]))
        h, _, _, n = text.words(data, offs)
        g, _ = text.grams(h, n, 5)
        s = part.similarity(g, i)
        assert s >= 0.75
        total += 1
        found += i in part.search(h, g, 75, 100)
    assert found >= 0.99 * total


def test_decontamination_of_a_benchmark_of_many_slices(spark, monkeypatch):
    rng = random.Random(6)
    items = some_items(rng, 23, 30) + ["a b c", "q"]
    rows = [(i, " ".join(["pre"] * (i % 4) + items[i % 25].split() + ["post"] * 9), 1) for i in range(50)] + [(60, None, 1), (61, "", 1), (62, "nothing of it at all " * 3000, 1), (0, None, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, touched int")
    bench = spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(items)] + [(3, None, 0, 0), (3, items[3], 0, 0)], "item_id long, text string, doc_id int, t int")
    whole = sorted(map(tuple, decontaminate.find_passages(d, bench).collect()))
    assert {x[:2] for x in whole} == {(i, i % 25) for i in range(50)}
    kept = sorted(str(tuple(r)) for r in decontaminate.without_passages(d, bench).collect())
    assert len(kept) == 4
    monkeypatch.setattr(decontaminate, "SLICE", 7)
    assert sorted(map(tuple, decontaminate.find_passages(d, bench).collect())) == whole
    assert sorted(str(tuple(r)) for r in decontaminate.without_passages(d, bench).collect()) == kept
    assert decontaminate.find_passages(d.limit(0), bench).count() == 0 and decontaminate.without_passages(d.limit(0), bench).columns == d.columns


# --- main text -----------------------------------------------------------------------------------------------------
def plain_kept(size):
    """Surge and dive points by definition: a line lives if one of the windows that hold it has any text."""
    n, k = len(size), main_text.WINDOW
    window = lambda i: sum(size[max(0, i - k + 1) : i + 1])
    forward = lambda i: sum(size[i : i + k])
    alive = [window(i) > 0 or forward(i) > 0 for i in range(n)]
    top = max((window(i) for i in range(n)), default=0)
    stretches, start = [], None
    for i in range(n + 1):
        if i < n and alive[i] and start is None:
            start = i
        if start is not None and (i == n or not alive[i]):
            if max(window(j) for j in range(start, i)) >= min(main_text.SHARE * top, main_text.PROSE):
                stretches.append((start, i))
            start = None
    return [i for i in range(stretches[0][0], stretches[-1][1]) if size[i]] if stretches else []


def test_distribution_against_a_plain_one():
    rng = random.Random(11)
    for _ in range(600):
        size = [rng.choice((0, 0, 0, 3, 20, 90, 400)) if rng.random() < 0.6 else 0 for _ in range(rng.randint(0, 40))]
        part = main_text.kept(np.array(size, int))
        assert [i for i in range(*part.indices(len(size))) if size[i]] == plain_kept(size)


def test_the_distribution_decides(monkeypatch):
    menu = "<ul class=menu>" + "<li><a href=/x>Some link</a></li>" * 8 + "</ul>"
    body = "<p>" + "body " * 80 + "</p>"
    for page, want in (
        (f"<div>home</div>{menu}{body}{menu}<div>tail</div>", {"body"}),
        (f"<article><div>Share</div>{menu}{body}{menu}<div>Tags</div></article>", {"body"}),
        (f"<article><div>Share</div>{menu}{body}{menu}<p>Done.</p></article>", {"body", "Done."}),
        (f"{body}<nav>{'<br>x' * 6}</nav><p>That is all.</p>", {"body", "That", "is", "all."}),
        (f"{body}{menu}<p>© 2020 somebody, all rights reserved.</p>", {"body"}),
    ):
        assert set(main_text.main_text(page).split()) == want
        with monkeypatch.context() as m:
            m.setattr(main_text, "kept", lambda size: slice(None))
            off = set(main_text.main_text(page).split())
        assert want <= off and (off != want or "Done." in want or "That" in want)


def test_main_text_of_odd_mark_up():
    assert main_text.main_text('<article><p class="ad">Buy<div>Real text here</div></article>') == "Real text here"
    assert main_text.main_text('<article><h1 class="article-header">Title x</h1><p class="search-engine-history">Once.</p></article>') == "Title x Once."
    assert main_text.main_text('<article><p>One<div class="cookie-notice">no</div><div id="post-comments">no</div><p>two</article>') == "One two"
    assert main_text.main_text("<article><div class=ad><b>no</div><p>yes</b> more</article>") == "yes more"
    assert main_text.main_text("<article><p>a<ul><li>b<li class=ad>c<li>d</ul>e</article>") == "a b d e"
    assert main_text.main_text("<article>" + "<p>word</p>" * 20_000) == " ".join(["word"] * 20_000)


class Reader(html.parser.HTMLParser):
    """Text of an article, element by element, of well-formed pages."""

    def __init__(self):
        super().__init__()
        self.stack, self.parts = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h2", "div", "nav", "footer"):
            self.parts.append("\n")
        if tag != "br":
            self.stack.append((tag, dict(attrs).get("class")))
        else:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.stack.pop()
        if tag in ("p", "h2", "div", "nav", "footer"):
            self.parts.append("\n")

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.stack) and not any(t in ("nav", "footer", "script", "style") or c == "ad" for t, c in self.stack):
            self.parts.append(data)

    def text(self):
        return " ".join(" ".join(x.split()) for x in "".join(self.parts).split("\n") if x.strip())


def test_main_text_against_a_plain_reader(spark):
    rng = random.Random(12)
    word = lambda: rng.choice(("alpha", "b&amp;c", "d&eacute;e", "&lt;x&gt;", "end."))
    pages = []
    for i in range(60):
        inner = "".join(
            rng.choice(("<p>{}</p>", "<h2>{}</h2>", "<p><b>{}</b></p>", "<p>{}<br>x</p>", "<div class='ad'>{}</div>", "<nav>{}</nav>", "<script>{}</script>")).format(" ".join(word() for _ in range(rng.randint(1, 30))))
            for _ in range(rng.randint(1, 25))
        )
        pages.append((i, "u", f"<html><body><nav><a href='/'>top</a></nav><div>outside</div><article><p>first</p>{inner}</article><footer>f</footer></body></html>"))
    want = {}
    for i, _, page in pages:
        r = Reader()
        r.feed(page)
        want[i] = r.text()
    d = spark.createDataFrame([(*p, 5) for p in pages], "page_id long, url string, html string, text int")
    assert {r.page_id: r.text for r in main_text.extract(d).collect()} == want
    assert main_text.extract(d.limit(0)).count() == 0


# --- licences ------------------------------------------------------------------------------------------------------
def test_licences_in_full(spark):
    import textwrap

    t = licenses.TEXTS
    wrap = lambda *parts: "\n\n".join(textwrap.fill(p, 80) for p in parts)
    texts = {
        "MIT": wrap("MIT License", "Copyright (c) 2020 A", t["mit-grant"] + ":", t["mit-notice"] + ".", "THE SOFTWARE IS PROVIDED AS IS."),
        "GPL-3.0-or-later": wrap(f"{t['gpl-free']}: {t['gpl-terms']}, {t['gpl3-later']}."), "AGPL-3.0-or-later": wrap(f"{t['gpl-free']}: {t['agpl-terms']}, {t['gpl3-later']}."),
        "LGPL-2.1-or-later": wrap(f"{t['lgpl-free']}; {t['lgpl-terms']}; {t['lgpl21-later']}."), "GPL-2.0": wrap(f"{t['gpl-free']}; {t['gpl-terms']}; {t['gpl2-only']}."),
        "ISC": wrap("ISC License", t["isc-grant"] + "."), "MPL-2.0": wrap("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed"),
        "Apache-2.0": "// Licensed under the Apache License, Version 2.0 (the \"License\");\n// you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at\n//\n",
        "Unlicense": wrap(t["unlicense"] + "."), "BSL-1.0": wrap(t["boost-grant"] + ":"), "Zlib": wrap(t["zlib-grant"] + ":"),
        "CC-BY-SA-4.0": "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.", "BSD-3-Clause": "Released under the BSD 3-Clause License, see LICENSE.txt for details.",
        "GPL-3.0": "this library is distributed under the terms of the GNU GPL v3", "": "The licence of a pub. Permission was given.",
    }
    spdx = {"MIT": "/* SPDX-License-Identifier: MIT */", "Apache-2.0,MIT": "# SPDX-License-Identifier: (MIT OR Apache-2.0)\nx", "GPL-2.0": "// spdx-license-identifier: GPL-2.0-only", "GPL-2.0-or-later": "SPDX-License-Identifier: GPL-2.0-or-later"}
    also = {"MIT": "Released under the MIT License, see LICENSE."}
    rows = [(k, v) for table in (texts, spdx, also) for k, v in table.items()]
    d = spark.createDataFrame([(i, v, 1, 2) for i, (_, v) in enumerate(rows)], "doc_id long, text string, b int, licenses int")
    got = {r.doc_id: r.licenses for r in licenses.scan(d).collect()}
    assert [got[i] for i in range(len(rows))] == [k for k, _ in rows]
    odd = spark.createDataFrame([(None, None), (1, "x"), (1, "x"), (2, "word " * 100_000 + "\nReleased under the MIT License\n")], "doc_id long, text string")
    assert sorted(map(str, (r.licenses for r in licenses.scan(odd).collect()))) == ["", "", "", "MIT"] and licenses.scan(odd.limit(0)).count() == 0


def test_every_rule_can_be_found():
    for name, sequence in licenses.RULES:
        keys = [k for k, v in licenses.SENTENCES.items() if v in sequence]
        assert len(set(licenses.SENTENCES[k] for k in keys)) == len(set(sequence)), name
        assert any(re.search(a, k) for k in keys for a in licenses.ANCHORS), name
    assert all(re.search(licenses.ANCHORED, k) for k in licenses.SENTENCES)
