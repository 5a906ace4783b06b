"""Each operator against a brute-force version on small rows with nulls, empty texts, ties, repeats and other columns."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cartolode.llm import langid, mixing, pii, secrets, simhash, urls, warc
from cartolode.llm.common import new_path
from cartolode.llm.components import connected_components
from cartolode.llm.decontaminate import find_leaks
from cartolode.llm.embeddings import embedding_groups

DOCS = "doc_id long, text string, lang string, source string, n_chars long, count int, size int, label string, word string, h int, fp int, t int"
WORDS = {
    "en": "the and of to that was with this have from house water night green stone".split(),
    "de": "der und die nicht ist auch sich haus wasser nacht gruen stein über schön für".split(),
}


def documents(spark, n=120, seed=1):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        text = " ".join(rnd.choice(WORDS[lang]) + rnd.choice(["", "", "s", "er", ","]) for _ in range(rnd.randint(1, 80)))
        rows.append((i, text, lang, f"src{i % 5}"))
    big = " ".join(rnd.choice(WORDS["en"]) for _ in range(30_000))
    rows += [(n, None, "en", "src0"), (n + 1, "", None, None), (n + 2, " \t\n", "en", None), (n + 3, "1234 ++ --", None, "src1"), (n + 4, big, "en", "src2")]
    rows += [(n + 5, rows[1][1], "en", "src1"), rows[2], rows[2], (None, "the house of stone", "en", "src3"), (n + 6, rows[4][1] + " end", "en", "src4")]
    rows += [(n + 7, "x" * 50_000, None, "src4"), (n + 8, "9" * 40_000 + "." * 10 + "+1" * 5000, None, "src4"), (n + 9, "a.b" * 20_000 + "@c", "en", "src4")]
    return spark.createDataFrame([(*r, None, 1, 2, "l", "w", 3, 4, 5) for r in rows], DOCS), rows


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_components_agree_with_union_find(spark):
    rnd = random.Random(5)
    links = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(400, k) for k in range(401, 460)] + [(k, k + 1) for k in range(500, 560)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components({x for pair in links for x in pair if x is not None}, [x for x in links if None not in x])
    assert got == {k: v for k, v in want.items() if k in got}
    assert all(v == k for k, v in want.items() if k not in got)


def test_secret_spans(spark):
    df, rows = documents(spark)
    more = ["token = 'abcdefghijkl' x", "PASSWORD:aaaaaaaaaaaaaaaa", "AKIA" + "B7" * 9, "id deadbeefdeadbeef0", "token=password:aaaaaaaaaaaaaaaa", "pwd: Tr0ub4dor&3x", "é\U0001f600 api_key=0123456789ab"]
    df = df.unionByName(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(more)], "doc_id long, text string"), allowMissingColumns=True)
    texts = Counter((r["doc_id"], r["text"]) for r in df.collect())
    got = secrets.scan_secrets(df).collect()
    assert len(got) == df.count()
    want = Counter()
    for (d, t), n in texts.items():
        t, spans = t or "", []
        for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
            spans += [(m.start(), 0, f"assign:{m.start()}:{m.end()}")] * (len(m[2]) >= 12)
        for k, name, pattern, least in ((1, "access", r"AKIA[A-Z0-9]+", 18), (2, "hex", r"[0-9a-f]+", 16)):
            spans += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(pattern, t) if len(m[0]) >= least]
        counts = Counter(k for _, k, _ in spans)
        want[d, counts[0], counts[1], counts[2], hashlib.sha256(",".join(s for *_, s in sorted(spans)).encode()).hexdigest()] += n
    assert Counter(tuple(r)[:5] for r in got) == want
    assert {r["doc_id"]: r["n_guess"] for r in got}[1005] == 1
    clean = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(df).collect()}
    assert clean[1000] == "token = '<secret>' x" and "Tr0ub" not in clean[1005] and clean[0] == rows[0][1]


def test_long_values_are_found_and_redacted_whole(spark):
    rnd = random.Random(9)
    for n in (199, 200, 201, 5000):
        value = "z" * (n - 30) + "".join(rnd.choice("bcdfghjkmnpqrstvwxyz#%23456789") for _ in range(30))
        base, added = secrets.scan(f"pwd is {value} x")
        assert not base and [(x[1], x[2]) for x in added] == [(7, 7 + n)]
        df = spark.createDataFrame([(1, f"pwd is {value} x")], "doc_id long, text string")
        assert secrets.redact_secrets(df).first()["text"] == "pwd is <secret> x"
    assert not secrets.scan("pwd is " + "1" * 5000)[1]
    df = spark.createDataFrame([(1, "token=abcDEF123456#9x!Qw7 pwd: deadbeefdeadbeef!Zq9# x")], "doc_id long, text string")
    assert secrets.redact_secrets(df).first()["text"] == "token=<secret> pwd: <secret> x"


def test_guess_cost_takes_the_cheapest_segments():
    cost = secrets.guess_cost
    assert cost("password") < cost("passwordx") < cost("p9sswqrdx")
    assert cost("qwertyuiop") < 5 and cost("aaaaaaaaaaaa") < 4 and cost("20240101") < 5.5 and cost("abcabcabcabc") < 6
    assert cost("x9$Kq2!vLm") > 15 and cost("") == 0 and math.isfinite(cost("z8" * 100))


def luhn(digits):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_pii_base_spans(spark):
    df, _ = documents(spark)
    more = ["mail a.b@c.example.com_d@e.org x", "10.0.0.1 1.2.3.4.5 999.1.1.1 0000255.1.1.1", "card 4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (389) 555-5010 +12 +33 1 23 45 67 89.", "é\U0001f600 z@y.de", "call 389-555-5010 now", "ssn 123-45-6789", "@x@y.z@w.v"]
    df = df.unionByName(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(more)], "doc_id long, text string"), allowMissingColumns=True)
    got = pii.find_pii(df).collect()
    assert len(got) == df.count()
    want, found = Counter(), []
    for d, t in df.select("doc_id", "text").collect():
        t, spans = t or "", []
        patterns = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
        for kind, p in patterns:
            if kind == "email" and len(t) > 40_000:
                continue
            for m in re.finditer(p, t):
                digits = re.sub("[^0-9]", "", m[0])
                ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".") if len(x) < 30), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
                spans += [(kind, f"{kind}:{m.start()}:{m.end()}")] * ok
        c = Counter(k for k, _ in spans)
        want[d, c["email"], c["ip"], c["card"], c["phone"], hashlib.sha256(",".join(s for _, s in spans).encode()).hexdigest()] += 1
        found += spans
    assert Counter(tuple(r)[:6] for r in got) == want and len(found) >= 8
    assert all(r["spans"].count(":") // 2 == sum(r[f"n_{k}"] for k in pii.BASE) + r["n_added"] for r in got)


def test_language_identification(spark):
    df, rows = documents(spark, 400)
    model = langid.train(df)
    assert model.langs == ["de", "en"]
    got = langid.identify(df, model).collect()
    assert len(got) == df.count() and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r["lang_pred"] for r in got}
    right = [by_id[r[0]] == r[2] for r in rows[:400] if len(r[1]) > 40]
    assert sum(right) / len(right) > 0.98
    assert [by_id[400 + k] for k in range(4)] == ["und"] * 4
    for context in ("th", "un", " h"):
        codes = np.array([[32] * 3 + [ord(c) for c in context] + [x] for x in list(range(97, 123)) + [32, 44, 252, 246]], np.uint32)
        mass = sum(np.exp(model.log_probs(c)[-1]) for c in codes)
        assert (mass < 1.01).all() and (mass > 0.8).all()
    empty = df.limit(0)
    assert langid.train(empty) is None and langid.identify(df, None).where("lang_pred = 'und'").count() == df.count()


def test_embedding_groups(spark, monkeypatch):
    monkeypatch.setattr("cartolode.llm.embeddings.CELL", 40)
    monkeypatch.setattr("cartolode.llm.embeddings.TILE", 30)
    rng, rows = np.random.default_rng(3), []
    centers = rng.normal(size=(25, 8))
    for k in range(400):
        v = centers[k % 25] + rng.normal(size=8) * rng.choice([0.05, 0.3])
        rows.append((k, [float(x) for x in v], int(k % 2)))
    rows += [(400 + k, rows[5][1], rows[5][2]) for k in range(30)] + [(430, None, 1), (431, [0.0] * 8, 1), (432, [1.0, None], 1), (433, [float("nan")] * 8, 1), (434, rows[3][1], None), (435, rows[3][1][:4], 1), (436, [], 0)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, label int, cell int, n int, root int")
    valid = [(i, np.array(v) / np.linalg.norm(v), lab) for i, v, lab in rows if v and None not in v and lab is not None and np.isfinite(v).all() and np.linalg.norm(v)]
    links = [(a, b) for x, (a, u, p) in enumerate(valid) for b, v, q in valid[:x] if p == q and len(u) == len(v) and u @ v >= 0.93]
    degree, root = Counter(x for pair in links for x in pair), components([r[0] for r in rows], links)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_groups(df).collect()}
    assert got == {i: (degree[i], root[i], root[i] == i) for i, *_ in rows} and len(links) > 300
    assert embedding_groups(df.limit(0)).count() == 0


def test_decontamination(spark):
    rnd = random.Random(2)
    items = [(k, " ".join(rnd.choice(WORDS["en"]) + rnd.choice("abcdefgh") for _ in range(30))) for k in range(12)] + [(98, None), (99, "ab")]
    noisy = lambda t, n: "".join(c if k not in at else rnd.choice(["", "q", c + "q"]) for at in [set(rnd.sample(range(len(t)), n))] for k, c in enumerate(t))
    filler = lambda n: " ".join(rnd.choice(WORDS["de"]) for _ in range(n))
    rows, want = [], set()
    for k in range(12):
        for j, part in enumerate((items[k][1].upper().replace(" ", "\n "), noisy(items[k][1], len(items[k][1]) // 12), items[k][1][: len(items[k][1]) // 2])):
            rows.append((10 * k + j, f"{filler(k * 90)} {part} {filler(60)}"))
            want |= {(10 * k + j, k)} if j < 2 else set()
    rows += [(500, None), (501, ""), (502, filler(9000)), (None, items[0][1]), (503, "ab")]
    rows += [(504, f"Ab!{filler(3)} ab {filler(2)} abc xab a-b"), (505, f"{items[1][1]} {filler(5)} {items[1][1]}, {items[1][1]}")]
    items += [(100, items[1][1]), (None, items[1][1])]
    want |= {(None, 0), (503, 99), (504, 99), (505, 1)}
    want |= {(d, k) for d, i in want if i == 1 for k in (100, None)}
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, item_id int, t int")
    found = find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    counts = Counter((r["doc_id"], r["item_id"]) for r in found)
    assert counts[504, 99] == 2 and {counts[505, k] for k in (1, 100, None)} == {3} and sum(counts.values()) == len(want) + 7
    texts = dict(rows)
    exact = [r for r in found if r["distance"] == 0]
    assert len(exact) >= 13 and all(texts[r["doc_id"]][r["start"] : r["end"]].lower().split() == dict(items)[r["item_id"]].split() for r in exact)
    assert find_leaks(docs.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def slow_print(text):
    words = word_list("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("bucket", [2048, 3])
def test_simhash_groups(spark, bucket, monkeypatch):
    monkeypatch.setattr("cartolode.llm.simhash.near_links.__defaults__", (3, bucket))
    df, rows = documents(spark, 80)
    rnd = random.Random(8)
    base = " ".join(rnd.choice(WORDS["en"]) + rnd.choice("abcdef") for _ in range(300))
    near = [(2000 + k, " ".join(w if j != 7 * k else "stone" for j, w in enumerate(base.split()))) for k in range(25)]
    df = df.unionByName(spark.createDataFrame(near, "doc_id long, text string"), allowMissingColumns=True)
    all_rows = [(r[0], r[1]) for r in rows] + near
    prints = [(d, slow_print(t)) for d, t in all_rows]
    ids = {f: min((d for d, g in prints if g == f and d is not None), default=None) for _, f in prints}
    links = [(a, b) for a in ids for b in ids if a < b and (a ^ b).bit_count() <= 3]
    root = components(list(ids), links)
    least = defaultdict(list)
    for f, r in root.items():
        least[r] += [ids[f]] if ids[f] is not None else []
    want = Counter((d, f"{f:016x}", min(least[root[f]], default=None)) for d, f in prints)
    assert Counter(map(tuple, simhash.simhash_groups(df).collect())) == want and len(links) > 5


def test_covering_masks_leave_no_pair_out():
    masks, rnd = simhash.covering_masks(list(range(64)), 3), random.Random(1)
    assert len(masks) == 15
    for _ in range(3000):
        x = sum({1 << rnd.randrange(64) for _ in range(3)})
        assert any(not x & m for m in masks)


def test_url_rules_and_trees(spark):
    rnd = random.Random(4)
    hosts = [f"www.site{rnd.choice('abc')}.example.com" for _ in range(150)] + [f"spam-win-{k}-cash.example.org" for k in range(60)]
    rows = [(k, f"http://{h}/en/{k}?a=1#x") for k, h in enumerate(hosts)]
    rows += [(900, None), (901, "no scheme"), (902, "HTTP://A.Example.NET/en/x"), (903, "http://example.net"), (904, "http://x.example.com/de/?q"), (905, "http://fr.org/fr/"), (906, "http://notexample.net/en/"), (906, "http://notexample.net/en/"), (None, "x://?y"), (907, "http://a.org?b/c")]
    df = spark.createDataFrame([(*r, "h", "p", 1) for r in rows], "page_id long, url string, host string, path string, label int")
    got = {r["page_id"]: tuple(r)[1:5] for r in urls.filter_urls(df).collect()}
    assert got[900] == got[901] == got[None] == ("", "", None, "allow")
    assert got[902] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[903] == ("example.net", "", None, got[903][3])
    assert got[904][2:] == ("example.com/de/", "block") and got[905][2:] == ("org/fr/", "allow") and got[906][2:] == ("net/", "block")
    assert got[907][:2] == ("a.org", "") and {got[k][3] for k in range(150)} == {"allow"} and {got[k][3] for k in range(150, 210)} == {"block"}
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_warc_round_trip(spark):
    rnd = random.Random(6)
    rows = [(k, f"http://h/{k}", f"<p>{rnd.randint(0, 60)}é" * 40) for k in range(300)] + [(1000, None, None), (1001, "u", ""), (None, "u", "<p>1é" * 40), (5, "http://again\r\nX: y", "same id"), (1002, "big", "z" * 3_000_000)]
    df = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, size int")
    outs = []
    for parts in (1, 7):
        out = new_path(spark, "warc-test")
        manifest = warc.write_warc(df.repartition(parts), out, roll_bytes=20_000, shard_bytes=100_000, min_shards=4)
        outs.append({r["name"]: r["digest"] for r in manifest.collect()})
        got = warc.read_warc(spark, out, payloads=True).collect()
    assert outs[0] == outs[1] and len(outs[0]) > 4
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[(html or "").encode()].append(i)
    want = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        keeper = max(x for x in groups[data] if x is not None)
        want[i, len(data), warc.base32_sha1(data), "response" if i == keeper else "revisit", None if i == keeper else keeper] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    assert all(bytes(r["payload"]) == (dict((k, v) for k, _, v in rows if k == r["page_id"]).get(r["page_id"]) or "").encode() for r in got if r["payload"] is not None and r["page_id"] not in (None, 5))
    stale, path = next(iter(outs[1])), out.removeprefix("file://")
    Path(path, "data", "part-99999999-00000.warc.gz").write_bytes(b"left by another writer")
    assert not Path(path, "tmp").exists() and warc.read_warc(spark, out).count() == len(rows)
    data = Path(path, "data", stale).read_bytes()
    assert data.startswith(b"\x1f\x8b") and b"WARC-Type: warcinfo" in gzip.decompress(data)[:100]
    revisits = [m for f in Path(path, "data").glob("part-0*") for m in gzip.decompress(f.read_bytes()).split(b"WARC/1.1\r\n") if b"WARC-Type: revisit" in m]
    responses = b"".join(gzip.decompress(f.read_bytes()) for f in Path(path, "data").glob("part-0*"))
    assert revisits and all(b"WARC-Record-ID: " + re.search(rb"WARC-Refers-To: (\S+)", m)[1] in responses and b"WARC-Refers-To-Target-URI: http" in m for m in revisits)
    for broken in (data[:-9], data[:40] + bytes([data[40] ^ 1]) + data[41:], gzip.compress(gzip.decompress(data).replace(b"<p>", b"<q>"))):
        Path(path, "data", stale).write_bytes(broken)
        with pytest.raises(Exception):
            warc.read_warc(spark, out).collect()
    out = new_path(spark, "warc-empty")
    assert warc.write_warc(df.limit(0), out).count() == 0 and warc.read_warc(spark, out).count() == 0


def test_mixing(spark):
    df, rows = documents(spark, 600)
    got = mixing.mix_sources(df).collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(word_list(t))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped, target = sum(sizes.values()), set(), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, total)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, len(word_list(t))) for d, t, *_ in rows)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    largest = {s: max(len(word_list(t)) for _, t, _, x in rows if x == s) for s in order}
    assert all(abs(taken[s] - target[s]) <= max(largest[s], 1) for s in order)
    again = {(r["doc_id"], r["source"], r["size"]): r["taken"] for r in mixing.mix_sources(df.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["source"], r["size"]): r["taken"] for r in got}
    assert mixing.mix_sources(df.limit(0)).count() == 0
