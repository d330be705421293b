"""The ten operators against brute force on small fixtures, edge cases included."""

import collections
import hashlib
import io
import math
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodeseek.llm import components, context_tree, decontaminate, kernel, language, mixture, rows, rule_ledger, secrets, shingle_join, store, toxicity, url_templates, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def mixed_texts(seed=1, n=60):
    """Texts with copies, near copies, shared passages, repeated lines, odd characters, null and empty ones."""
    rng = random.Random(seed)
    vocabulary = [rng.choice("abcdefghij") + rng.choice(["la", "ÖR", "é", "x😀", "ing", "Tion"]) * rng.randint(1, 3) for _ in range(80)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    out = [None, "", " \n\t", "one", "one two", "One  TWO", "a\u2003b c", "x\x0by\x0cz"]
    for k in range(n):
        t = " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", "\n"]) for _ in range(rng.randint(3, 120)))
        if k % 5 == 0:
            t += "\n" + passage
        out.append(t)
        if k % 4 == 0:
            out.append(t)
            for _ in range(3):
                w = t.split(" ")
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
                out.append(" ".join(w))
    return out


def frame(spark, texts, first=10):
    """Documents with clashing extra columns, one repeated row and one null id."""
    rows = [(first + k, t, f"s{k % 3}" if k % 7 else None, "x", k) for k, t in enumerate(texts)]
    rows += [rows[-1], (None, "no id at all here", "s1", "x", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, token string, rep long")


def test_kernel_words():
    texts = pa.array(mixed_texts())
    got = []
    for _, _, buf, offs in kernel.blocks(texts, 500):
        lower = kernel.LOWER[buf]
        s, e, first = kernel.word_spans(lower, offs)
        words = [bytes(lower[a:b]).decode() for a, b in zip(s, e, strict=True)]
        got += [words[a:b] for a, b in zip(first, first[1:], strict=False)]
        h = kernel.span_hashes(lower, s, e)
        assert len(set(h.tolist())) == len(set(words))
    assert got == [WORD.findall(low(t)) for t in texts.to_pylist()]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500, 500 + k) for k in range(1, 100)] + [(k, k + 1) for k in range(700, 740)]
    ws = store.Workspace(spark, "t")
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long"), ws).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in touched}


def shingled(text, size):
    w = WORD.findall(low(text))
    return frozenset(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def roots(sets, percent):
    """The smallest index of each set's component, by all pairs of sets that share a shingle."""
    where, parent = collections.defaultdict(list), list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        for g in s:
            where[g].append(k)
    for a, s in enumerate(sets):
        for b, both in collections.Counter(k for g in s for k in where[g] if k < a).items():
            if 100 * both >= percent * (len(s) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(k) for k in range(len(sets))]


def copy_groups(seed):
    """Texts in groups that share no words with each other: what all pairs must find, at and around the bound."""
    rng, texts = random.Random(seed), []
    for g in range(200):  # a text, a longer one that it begins, and variants of each
        long = [f"p{g}w{rng.randrange(10**6)}" for _ in range(102)]
        for base in (long[:92], long):
            texts.append(" ".join(base))
            for _ in range(4):
                t = list(base)
                t[rng.randrange(len(t))] = f"p{g}v{rng.randrange(10**6)}"
                texts.append(" ".join(t))
    for g in range(150):  # chains of edited copies that lie in several components
        n = rng.randint(22, 82)
        group = [[f"c{g}w{rng.randrange(10**6)}" for _ in range(n)]]
        for _ in range(rng.randint(10, 30)):
            t = list(rng.choice(group))
            for _ in range(rng.choice([1, 1, 2])):
                t[rng.choice([rng.randrange(n), rng.choice([0, 1, n - 1, n - 2])])] = f"c{g}v{rng.randrange(10**6)}"
            group.append(t)
        texts += [" ".join(t) for t in group]
    for g in range(150):  # texts of 1 to 200 words from small vocabularies
        words = [f"r{g % 40}w{rng.randrange(60)}" for _ in range(rng.choice([1, 2, 4, 9, 25, 60, 120, 200]))]
        for _ in range(rng.randint(1, 8)):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.choice([0, 1])] = rng.choice([[], [f"r{g}n{rng.randrange(10**6)}"]]) or ["x"]
    base = [f"h{rng.randrange(10**6)}" for _ in range(60)]  # one large group of near copies, some of them just not linked
    for _ in range(120):
        t = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            t[rng.randrange(60)] = f"hv{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    texts += mixed_texts(seed, 40)
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("percent", "size"), [(90, 3), (80, 5)])
def test_jaccard(spark, percent, size):
    texts = copy_groups(percent)
    sets = [shingled(t, size) for t in texts]
    want = roots(sets, percent)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"token": F.lit("x"), "rep": F.lit(1), "row_id": F.lit(2)})
    got = {r.doc_id: r for r in shingle_join.jaccard_components(docs, percent=percent, size=size).collect()}
    assert len(got) == len(texts)
    assert [k for k, r in got.items() if (r.n_shingles, r.component_id) != (len(sets[k]), want[k])] == []
    assert len(set(want)) < 0.7 * len(texts)


def test_deduplicated_rows(spark):
    """Rows are judged by their own texts: null and repeated ids neither lose unique texts nor hide copies."""
    rng = random.Random(3)
    t, u, v, w = (" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(40)) for c in "tuvw")
    near = t.rsplit(" ", 1)[0]
    rows = [(1, t, "a"), (5, t, "b"), (5, u, "c"), (None, near, "d"), (None, v, "e"), (None, v, "f"), (9, w, "g"), (9, w, "g"), (7, None, "h"), (7, "", "i"), (7, "", "i"), (None, None, "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_id string")
    got = sorted(map(str, shingle_join.deduplicated(docs).collect()))
    kept = [r for r in docs.collect() if r.row_id in "acghij"]
    kept.remove(next(r for r in kept if r.row_id == "g"))
    either = [sorted(map(str, [*kept, r])) for r in docs.collect() if r.row_id in "ef"]
    assert got in either
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in shingle_join.jaccard_components(docs).collect()}
    assert {(1, 38, 1), (5, 38, 1), (5, 38, 5), (None, 37, 1), (None, 38, None), (9, 38, 9), (7, 0, 7), (None, 0, None)} == found


def test_rows_by_key(spark):
    docs = frame(spark, mixed_texts(5, 40)).withColumn("at_key", F.lit(1)).withColumn("MAYBE_key", F.lit(2))
    keys = rows.keyed(docs.where("doc_id % 3 = 0 or doc_id is null")).select(*rows.KEY)
    ws = store.Workspace(spark, "t")
    left = rows.without(docs, keys, ws)
    assert left.columns == docs.columns
    assert sorted(map(str, left.collect())) == sorted(str(r) for r in docs.collect() if r.doc_id is not None and r.doc_id % 3)
    assert rows.without(docs, keys.limit(0), ws).count() == docs.count()
    inside = rows.within(docs, keys.distinct()).select("d.*")
    assert sorted(map(str, inside.collect())) == sorted({str(r) for r in docs.collect() if r.doc_id is None or r.doc_id % 3 == 0})


def test_empty_tables(spark):
    none = frame(spark, ["x"]).limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert shingle_join.jaccard_components(none).count() == 0
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.contamination(frame(spark, ["a b"]), items).where("contaminated").count() == 0
    assert rule_ledger.ledger(none).count() == 0
    assert secrets.scan(none).count() == 0 and secrets.redact(none).count() == 0
    assert warc.round_trip(pages).count() == 0 and url_templates.judge(pages).count() == 0
    assert mixture.taken(none).count() == 0
    assert context_tree.score(none).count() == 0
    assert language.identify(none.withColumn("lang", F.lit("en"))).count() == 0
    assert toxicity.detect(none, labels).count() == 0
    got = language.identify(frame(spark, ["a b"]).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}


def test_quality_rules(spark):
    texts = [*mixed_texts(7), "a b c d e " * 4, "same line here\n" * 5, "x|y & z # " * 20]
    docs = frame(spark, texts)
    led = rule_ledger.ledger(docs, "text").collect()
    assert len(led) == docs.count()
    for r in led:
        t = r.text or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        twice = collections.Counter(grams)
        covered = {p for i, g in enumerate(grams) if twice[g] > 1 for p in range(i, i + 5)}
        want = (len(w), sum(map(len, w)), len(re.findall(rule_ledger.SYMBOLS, t)), len(lines), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == want
    frame_ = rule_ledger.ledger(docs)
    p = rule_ledger.POLICIES["2024-1"]
    kept = rule_ledger.apply_policy(frame_, p).where("kept").count()
    for a in rule_ledger.ablation(frame_, p).collect():
        without = rule_ledger.Policy("x", tuple(x for x in p.rules if x != a.rule))
        assert a.kept_without == rule_ledger.apply_policy(frame_, without).where("kept").count() >= kept
        assert a.kept_without - kept == a.fails_alone


@pytest.mark.parametrize("small", [True, False])
def test_decontamination(spark, small, monkeypatch):
    monkeypatch.setattr(decontaminate, "SMALL", 10**6 if small else 0)
    rng = random.Random(11)
    texts = mixed_texts(13, 40)
    long = [WORD.findall(t) for t in texts if t and len(t) > 200]
    items = [None, "", "...", "One two"] + [" ".join(rng.choice(long)[2:20]).upper() for _ in range(8)] + [" ".join(rng.choice(long)[:4]) for _ in range(2)] + [" ".join(w * 2) for w in long[:2]]
    named_items = [*enumerate(items), (len(items), items[-3]), (None, items[4])]
    wins = collections.defaultdict(set)
    for i, t in named_items:
        w = TERM.findall(low(t))
        for s in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[s : s + 10])].add(i)
    docs = frame(spark, texts)
    # ids that are null or shared by different texts, contaminated and clean
    odd = [(None, items[4], None, "x", 0), (12, items[5] + " more", None, "x", 0), (12, "a clean text", None, "x", 0), (None, "clean as well", None, "x", 0)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    got = decontaminate.contamination(docs, spark.createDataFrame(named_items, "item_id long, text string").withColumn("phrase", F.lit(1))).collect()
    want, bad = [], []
    near = {(k, t): n for k, t, n in near_counts(docs, named_items)}
    for r in docs.collect():
        w, hit, named = TERM.findall(low(r.text)), set(), set()
        for n in {len(g) for g in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    named |= wins[tuple(w[s : s + n])]
        names = sorted(str(x) for x in named if x is not None)
        want.append((r.doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit), near[r.doc_id, r.text]))
        bad += [r] * (not hit)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(r.contaminated for r in got) > 3 and sum(r.n_near for r in got) > 3
    kept = decontaminate.decontaminated(docs, spark.createDataFrame(named_items, "item_id long, text string"))
    assert sorted(map(str, kept.collect())) == sorted(map(str, bad)) and kept.columns == docs.columns


def near_counts(docs, items, terms=decontaminate.NEAR_TERMS, span=decontaminate.NEAR_SPAN):
    """For each row the number of named items whose rarest words stand within ``span`` words of the rarest one, by brute force."""
    texts = [(r.doc_id, r.text, TERM.findall(low(r.text))) for r in docs.collect()]
    df = collections.Counter(x for _, _, w in texts for x in w)
    out = []
    for k, t, w in texts:
        found = set()
        for i, item in items:
            rare = sorted({(df[x], x) for x in TERM.findall(low(item))})[:terms]
            if rare and rare[0][0] > 0 and any(all(any(abs(p - q) <= span for q, y in enumerate(w) if y == z) for _, z in rare[1:]) for p, x in enumerate(w) if x == rare[0][1]):
                found.add(i)
        out.append((k, t, len(found - {None})))
    return out


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "zeta one two alpha x beta"), (2, "zeta " + "y " * 50 + "alpha beta"), (3, "none"), (4, "y " * 59 + "zeta " + "y " * 18 + "alpha beta")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta zeta")], "item_id long, text string")
    got = decontaminate.Search(docs, items, store.Workspace(spark, "t")).proximity(20).collect()
    assert {(r.row_id, r.item_id, r.at) for r in got} == {(1, "7", 3), (4, "7", 78)}


def test_secrets(spark):
    texts = [
        None, "", "é token = 'abcdef' x", "password: abc", "ApiKey=\"ABCDEF==\" AKIA" + "Q" * 16, "😀 " + "0123456789abcdef" * 2, "secret=secret=abcdefgh", "passwd =\x20\x20:abc", "k 9aZ3xQ7pL2vB8nM4tR6w end",
        "see https://x.com/9aZ3xQ7pL2vB8nM4tR6w", "id 123e4567-e89b-12d3-a456-426614174000", "AKIASHORT", "a" * 300, "token=abcdef" * 3,
    ]
    docs = frame(spark, texts)
    pattern = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    text_of = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in secrets.scan(docs).collect():
        t = text_of[r.doc_id]
        base = [(m.start(), 0, m.end()) for m in pattern.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert r.base_sha256 == hashlib.sha256(secrets.digest(sorted(base)).encode()).hexdigest(), t
        assert {secrets.digest([x]) for x in base} <= set(r.spans.split(","))
        assert (r.n_entropy > 0) == t.startswith("k 9aZ")
    red = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert red[10].text is None and red[12].text == "é [REDACTED]' x" and red[12].token == "x"
    assert secrets.scan(secrets.redact(docs)).where("n_assign + n_access + n_hex > 0").count() == 0


def test_secrets_beside_explained_parts():
    key = "9aZ3xQ7pL2vB8nM4tR6wY1cK5dH0jFsG"
    texts = [f"-----{key}", f"======{key}", f"sample_{key}", f"PATH=/opt/sample/{key}", f"{key}/" + "0123456789abcdef" * 2]
    quiet = ["id 123e4567-e89b-12d3-a456-426614174000", "sha256-" + "47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=", f"https://x.com/{key}", f"token={key}"]
    got = list(secrets.find(pa.array(texts + quiet)))
    for t, spans in zip(texts, got, strict=False):
        at = t.index(key)
        assert {p for a, k, b in spans if k == 3 for p in range(a, b)} >= set(range(at, at + len(key))), t
    assert not any(k == 3 for spans in got[len(texts) :] for _, k, _ in spans)


def test_secrets_after_long_urls():
    """An unbroken url explains its parts, however long it is."""
    key = "9aZ3xQ7pL2vB8nM4tR6wY1cK5dH0jFsG"
    texts = [f"https://x.io/{'a.b' * 20}/{key}", f"https://x.io/{'a.b' * 200}.{key}", f"see https://x.io/{'a.b' * 200} {key}", f"{'a.b' * 200}.{key}"]
    assert [any(k == 3 for _, k, _ in spans) for spans in secrets.find(pa.array(texts))] == [False, False, True, True]


def test_entropy_windows():
    rng = random.Random(4)
    for _ in range(200):
        s = "".join(rng.choice("abcdef0123456789ABCDxyz") for _ in range(rng.randint(10, 60))).encode()
        covered = set()
        for k in range(len(s) - 19):
            w = s[k : k + 20]
            bits = -sum(c / 20 * math.log2(c / 20) for c in collections.Counter(w).values())
            digits, lower, upper = (sum(a <= b <= z for b in w) for a, z in ((48, 57), (97, 122), (65, 90)))
            beyond = any(b in b"ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ" for b in w)
            bound = secrets.HEX_BITS if not beyond and not (lower and upper) else secrets.MIXED_BITS if lower and upper else secrets.CASE_BITS
            if digits >= 2 and lower + upper >= 2 and bits >= bound - 1e-9:
                covered |= set(range(k, k + 20))
        assert {p for a, b in secrets.entropy_windows(s) for p in range(a, b)} == covered


def test_warc(spark, tmp_path):
    big, rng = "ü" * 200, random.Random(1)
    rows = [(3, "u3", big), (1, "u1", big), (2, "u2", None), (4, "u\r\nX: y", "short"), (5, "u5", "short"), (None, "n", big), (1, "u1", big), (9, None, "".join(chr(rng.randrange(32, 3000)) for _ in range(20000)))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = sorted(map(str, map(tuple, warc.round_trip(pages).collect())))
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        of = first.get(b) if len(b) >= 100 else None
        again = of is not None and of != i
        want.append(str((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", of if again else None)))
    assert got == sorted(want)
    path = f"file://{tmp_path}/w"
    warc.write(warc.to_records(pages, store.Workspace(spark, "w")), path)
    assert warc.read(spark, path, payload=False).where("record_type = 'revisit'").where("payload is not null").count() == 0
    assert warc.read(spark, path).where("page_id = 9").first().payload.decode() == rows[-1][2]
    assert warc.read(spark, path).where("page_id = 4").first().target_uri == "u%0D%0AX: y"


def test_warc_commits(spark, tmp_path):
    """Appending keeps what is there, overwriting replaces it, and files that no manifest lists stay."""
    path = f"file://{tmp_path}/w"
    one, two, three = (warc.to_records(spark.createDataFrame([(k, f"u{k}", "x" * 200)], "page_id long, url string, html string"), store.Workspace(spark, "w")) for k in (1, 2, 3))
    ids = lambda: sorted(r.page_id for r in warc.read(spark, path).collect())
    warc.write(one, path)
    (tmp_path / "w" / "foreign.warc.gz").write_bytes(b"not ours")
    warc.write(two, path)
    assert ids() == [1, 2]
    warc.write(three, path, "overwrite")
    assert ids() == [3]
    assert (tmp_path / "w" / "foreign.warc.gz").exists() and len(list((tmp_path / "w").glob("*.warc.gz"))) == 2


def test_warc_pushdown(spark, tmp_path, monkeypatch):
    """Predicates reach the reader, cut files are read whole, and unwanted payloads are neither inflated nor fetched."""
    rng = random.Random(2)
    rows_ = [(k, f"u{k}", "".join(chr(rng.randrange(32, 3000)) for _ in range(60000)) if k < 12 else "copy" * 50) for k in range(24)]
    pages, path = spark.createDataFrame(rows_, "page_id long, url string, html string"), f"file://{tmp_path}/w"
    warc.write(warc.to_records(pages, store.Workspace(spark, "w")).coalesce(1), path)
    r = warc.read(spark, path, payload=False).where("record_type = 'revisit'")
    assert " Filter " not in r._jdf.queryExecution().executedPlan().toString()
    got = r.collect()
    assert {x.page_id for x in got} == set(range(13, 24)) and {(x.refers_to, x.profile) for x in got} == {(12, warc.REVISIT)}
    assert {x.refers_to_id for x in got} == {warc.read(spark, path).where("page_id = 12").first().record_id}
    (archive,) = (tmp_path / "w").glob("*.warc.gz")
    size, counts = archive.stat().st_size, collections.Counter()

    class Counted(io.FileIO):
        def read(self, n=-1):
            data = super().read(n)
            counts["read"] += len(data)
            return data

    inflate = zlib.decompressobj

    class Inflating:
        def __init__(self, *a):
            self.z = inflate(*a)

        def decompress(self, *a):
            out = self.z.decompress(*a)
            counts["inflated"] += len(out)
            return out

        def __getattr__(self, name):
            return getattr(self.z, name)

    monkeypatch.setattr(warc.zlib, "decompressobj", Inflating)
    with Counted(archive) as f:
        assert len(list(warc.records(f, size, lambda h: h["warc-type"] == "revisit", False))) == 11
    assert counts["read"] <= 24 * warc.HEAD < size / 10 and counts["inflated"] <= 24 * 4096
    monkeypatch.undo()
    monkeypatch.setattr(warc, "SPLIT", 200_000)
    reader = warc.WarcReader(f"file://{archive}", True, ["page_id"])
    cut = f"file://{tmp_path}/cut"
    writer = warc.WarcWriter(cut, False)
    whole = next(warc.WarcReader(path, True, [*warc.HEADERS, "payload"]).read(warc.Split(((str(archive), 0, size),))))
    assert reader.partitions()
    batches = [*warc.WarcReader(path, True, [*warc.HEADERS, "payload"]).read(warc.Split(((str(archive), 0, size),)))]
    writer.commit([writer.write(iter(batches))])
    reader = warc.WarcReader(cut, True, ["page_id"])
    parts = reader.partitions()
    assert len(parts) > 3 and whole.num_rows
    assert sorted(x for p in parts for b in reader.read(p) for x in b.column(0).to_pylist()) == list(range(24))


def test_warc_of_other_writers():
    import gzip
    import io

    raw = b"WARC/1.0\r\nwarc-type: response\r\nX-Page-Id: 5\r\nContent-Length: 70000\r\n\r\n" + b"z" * 70000 + b"\r\n\r\n"
    data = gzip.compress(raw) + gzip.compress(raw.replace(b"response", b"metadata"))
    for payloads in (True, False):
        got = list(warc.records(io.BytesIO(data), len(data), lambda h: h["warc-type"] == "metadata", payloads))
        assert len(got) == 1 and (got[0][1] == b"z" * 70000 if payloads else got[0][1] is None)


def test_urls(spark):
    urls = [None, "x", "://", "http://", "a://B.Com/en/1?q#f", "http://example.com/en/7", "http://sub.example.com/en/70/x", "http://notexample.com/en/7", "ftp://X.NET/de/", "http://example.net/de/8", "http://a.org/es/", "http://org/es/x", "http://h?a/b", "http://h#x/en/", "http://h://z/y"]
    urls += [f"http://big.net/shop/{k}" for k in range(60)] + [f"http://big.net/item/{'abcdefgh'[k % 8]}{k}x/z" for k in range(60)]
    rows = [(k, u) for k, u in enumerate(urls)] + [(3, urls[4]), (None, urls[5])]
    of = dict(rows)
    got = url_templates.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    for r in got:
        u = of[r.page_id] if r.page_id != 3 else None
        if u is None:
            continue
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = low(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [x for x in url_templates.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.text), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best.text if best else None)
        assert r.verdict == (best.verdict if best else "allow")
    t = {r.url if hasattr(r, "url") else r.path: r.template for r in got}
    assert t["/shop/5"] == "/shop/{n}" and t["/item/a0x/z"] == "/item/*/z"


def test_method_verdicts(spark):
    """Urls that no rule fits are blocked by their templates: by a wildcard that holds ruled urls, and by siblings whose rates agree."""
    rules = (url_templates.Rule("block", "h.com/a/"), url_templates.Rule("block", "h.com/b/"), url_templates.Rule("block", "n.com/shop/1"), url_templates.Rule("block", "m.com/x/"), url_templates.Rule("allow", "m.com/y/"))
    urls = [f"http://h.com/{s}/{k}" for s, n in (("a", 40), ("b", 40), ("c", 10)) for k in range(n)] + [f"http://n.com/shop/{k}" for k in range(200)] + [f"http://m.com/{s}/{k}" for s in "xyz" for k in range(40)]
    got = url_templates.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r.host, r.path.rsplit("/", 1)[0], r.rule].add(r.verdict)
    assert by["h.com", "/c", None] == {"block"} and by["n.com", "/shop", None] == {"block"}
    assert by["m.com", "/z", None] == {"allow"} and by["m.com", "/y", "m.com/y/"] == {"allow"}
    # with one rate alone nothing is known of a sibling
    got = url_templates.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules[:1]).where("path like '/c/%'").collect()
    assert {r.verdict for r in got} == {"allow"}


def test_template_purity(spark):
    rows = [("h", f"/{d}/{{n}}", True) for d in ("a", "b") for _ in range(40)] + [("h", "/c/{n}", False)] * 40 + [("h", "/d/{n}", None)] * 10
    got = {r.template: r.purity for r in url_templates.purities(spark.createDataFrame(rows, "host string, template string, blocked boolean")).collect()}
    assert got["/c/{n}"] < 0.2 and got["/d/{n}"] == 0.5 and got["/a/{n}"] == got["/b/{n}"] > url_templates.REJECT


def test_mixture(spark):
    docs = frame(spark, mixed_texts(17, 200))
    got = mixture.taken(docs, block=4).collect()
    assert len(got) == docs.count()
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixture.targets([sizes[s] for s in order]), strict=True))
    taken = collections.Counter()
    for r in got:
        assert (r.source_size, r.target) == (sizes[r.source], want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 4 + 0.01 * want[s] for s in order)
    again = mixture.taken(docs.repartition(3), block=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    text = mixture.mixed(docs.where("doc_id is not null"), block=4).groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()
    assert {r.source for r in text} == set(order)


def test_mixture_by_brute_force(spark, monkeypatch):
    """taken, from packed words, drawn shards and permutations, one slot after the other."""
    block, per_shard = 4, 16
    docs = frame(spark, mixed_texts(29, 120)).dropDuplicates(["doc_id"])
    of = collections.defaultdict(list)
    for r in docs.collect():
        of[r.source].append((r.doc_id, len(WORD.findall(r.text or ""))))
    order = sorted(of, key=lambda s: (s is None, s or ""))
    planned = mixture.plan_sources([(s, sum(n for _, n in of[s]), len(of[s])) for s in order], block)
    packed = []
    for s, p in zip(order, planned, strict=True):
        buckets = math.isqrt(p.docs)
        spot = lambda i: (xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest() if i is not None else 42)
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        rows_ = sorted((signed(spot(i)) % buckets, i is not None, i or 0, n) for i, n in of[s])
        packed.append([i if named else None for _, named, i, n in rows_ for _ in range(n)])
    draws = np.array([p.draws for p in planned])
    total, seen, queue = int(draws.sum()), [0] * len(order), []
    for shard in range(-(-total // per_shard)):
        c = np.random.default_rng([mixture.SEED, shard]).multinomial(min(per_shard, total - shard * per_shard), draws / draws.sum())
        for k, n in enumerate(c):
            queue += [(k, seen[k] + x) for x in range(n)]
            seen[k] += n
    # draws beyond a source's number go, in order of source and draw, to the sources that fell short
    short = [(k, x) for k in range(len(order)) for x in range(seen[k], draws[k])]
    spare = iter(short)
    moved = {q: next(spare) for q in sorted(q for q in queue if q[1] >= draws[q[0]])}
    taken = collections.Counter()
    for q in queue:
        k, j = moved.get(q, q)
        e, at = divmod(j, planned[k].blocks)
        b = int(mixture.permuted(np.array([at]), planned[k].blocks, hash((mixture.SEED, k, int(e))))[0])
        for i in packed[k][b * block : (b + 1) * block]:
            taken[i, order[k]] += 1
    monkeypatch.setattr(mixture.shard_counts, "__defaults__", (per_shard, mixture.SEED))
    monkeypatch.setattr(mixture.slots, "__defaults__", (per_shard, mixture.SEED))
    got = {(r.doc_id, r.source): r.taken for r in mixture.taken(docs, block=block).collect()}
    assert moved and got == {(i, s): taken[i, s] for s in order for i, _ in of[s]}


def test_targets_and_permutation():
    assert mixture.targets([10, 10, 10]) == [18.75, 7.5, 3.75]
    t = mixture.targets([1, 50, 49])
    assert t[0] == 3 and abs(sum(t) - 100) < 1e-9 and abs(t[1] / t[2] - 2) < 1e-9
    assert mixture.targets([0, 0]) == [0, 0] and mixture.targets([]) == []
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        assert sorted(mixture.permuted(np.arange(n), n, 5).tolist()) == list(range(n))


def test_context_tree(spark):
    texts = mixed_texts(19, 14)
    docs = frame(spark, texts)
    rows_, d = docs.collect(), context_tree.DEPTH
    train = [r for r in rows_ if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    count = collections.Counter(w for r in train for w in WORD.findall(low(r.text)))
    n, v = sum(count.values()) + len(train), len(count) + 1
    seen, kids = collections.Counter(), collections.defaultdict(set)

    def bits(b):
        p = 1
        for k in range(7, -1, -1):
            yield p, b >> k & 1
            p = 2 * p + (b >> k & 1)

    def grams(t):
        s = b"\n" * d + "".join(w + " " for w in WORD.findall(low(t))).encode() + b"\n"
        return [(s[i - d : i], s[i]) for i in range(d, len(s))]

    for (ctx, b), c in collections.Counter(g for r in train for g in grams(r.text)).items():
        for p, x in bits(b):
            for k in range(d + 1):
                seen[ctx[d - k :], p, x] += c
                if k < d:
                    kids[ctx[d - k :], p].add(ctx[d - k - 1 :])
    memo, known = {}, {}

    def pe(ctx, p):
        a, b = seen[ctx, p, 0], seen[ctx, p, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - 2 * math.lgamma(0.5)

    def pw(ctx, p):
        if (ctx, p) not in memo:
            e = pe(ctx, p)
            memo[ctx, p] = e if len(ctx) == d else np.logaddexp(math.log(0.5) + e, math.log(0.5) + sum(pw(k, p) for k in kids[ctx, p]))
        return memo[ctx, p]

    def lp(ctx, b):
        if (ctx, b) in known:
            return known[ctx, b]
        out = 0
        for p, x in bits(b):
            q, deeper = 0.5, False
            for k in range(d, -1, -1):
                c = ctx[d - k :]
                a, t = seen[c, p, x], seen[c, p, 0] + seen[c, p, 1]
                if t:
                    g = math.exp(math.log(0.5) + pe(c, p) - pw(c, p)) if deeper else 1.0
                    q, deeper = g * (a + 0.5) / (t + 1) + (1 - g) * q, True
            out += math.log10(q)
        known[ctx, b] = out
        return out

    for ctx in (b"\n" * d, b"ing la"[:d]):
        assert abs(sum(10 ** lp(ctx, b) for b in range(256)) - 1) < 1e-9
    want = []
    for r in rows_:
        w = WORD.findall(low(r.text))
        base = sum(math.log10((count[k] + 1) / (n + v + 1)) for k in w) + math.log10((len(train) + 1) / (n + v + 1))
        want.append((str(r.doc_id), len(w) + 1, sum(count[k] > 0 for k in w) + 1, base, sum(lp(*g) for g in grams(r.text))))
    for hot in ((context_tree.HOT_WORDS, context_tree.HOT_GRAMS), (20, 50)):
        got = context_tree.score(docs, hot_words=hot[0], hot_grams=hot[1]).collect()
        found = [(str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in got]
        assert {r.train_tokens for r in got} == {n}
        for x, y in zip(sorted(found), sorted(want), strict=True):
            assert x[:3] == y[:3] and abs(x[3] - y[3]) < 1e-8 * abs(y[3]) and abs(x[4] - y[4]) < 1e-8 * abs(y[4])


def test_word_order_counts(spark):
    """The model knows word sequences: texts in their order are shorter to code than with their words shuffled, and than by words alone."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en'").select("doc_id", "text")
    rng, rows_ = random.Random(1), []
    for k in range(60):
        rows_.append((10**6 + k, " ".join(["the old mill stands", "by the river", "and grinds no corn"][j] for j in (rng.randrange(3) for _ in range(5)))))
    probe = "the old mill stands by the river and grinds no corn"
    rows_ += [(2 * 10**6 + 2, probe), (2 * 10**6 + 11, "corn the no mill and by river the stands grinds old")]
    assert [zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows_[-2:]] == [True, True]
    got = {r.doc_id: r for r in context_tree.score(docs.unionByName(spark.createDataFrame(rows_, docs.schema))).collect()}
    a, b = got[2 * 10**6 + 2], got[2 * 10**6 + 11]
    assert abs(a.base_score - b.base_score) < 1e-9 and a.score > b.score + 3 and a.score > a.base_score


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, "123 ... ☃"), (3, ""), (None, "der die das und ist nicht"), (5, "жук")], "doc_id long, text string")
    model = language.learn(docs.where("lang is not null"))
    pred = {r.doc_id: r.lang_pred for r in language.predict(odd, model, "doc_id").collect()}
    assert pred[1] == pred[2] == pred[3] == "und" and pred[None] == "de" and pred[5] != "und"


def test_kernel_ridge_by_brute_force():
    """Features are the texts' n-gram sets, and scores those of ridge regression on Nystroem features solved the long way."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice(w) for _ in range(rng.randint(1, 40))) for w in (["der", "das", "und"], ["the", "and", "of"], ["le", "la", "et"]) for _ in range(30)]
    texts += ["", "A  b\tC", "ö"]
    buf, offs = kernel.flat(pa.array(texts))
    x = language.presence(buf, offs)

    def feature(gram):
        code = gram[0]
        for k, b in enumerate(gram[1:], 1):
            code = (code * 257 + b + k) % 2**32
        return ((code * 0x9E3779B1) % 2**32) >> (32 - language.FEATURES_LOG2)

    for t, row in zip(texts, x, strict=True):
        raw = re.sub(r"[\x20\x09-\x0D]", " ", low(t)).encode()
        assert set(np.flatnonzero(row)) == {feature(raw[i : i + k]) for k in (1, 2, 3) for i in range(len(raw) - k + 1)}
    labels = [v for v in ("de", "en", "fr") for _ in range(30)]
    model = language.fit(x[:90], labels, landmarks=12)
    unit = lambda a: a / math.sqrt(max(1, a.sum()))
    marks = [unit(x[30 * (k % 3) + k // 3].astype(float)) for k in range(12)]
    cross = np.array([[float(unit(row.astype(float)) @ m) for m in marks] for row in x])
    inner = np.array([[float(a @ b) for b in marks] for a in marks])
    # kernel ridge in the landmarks' span: minimise sum (C w - y)^2 / 30 + ridge * w' K w
    for k, name in enumerate(("de", "en", "fr")):
        y = np.where(np.array(labels) == name, 1.0, -1.0)
        w = np.linalg.lstsq(cross[:90].T @ cross[:90] / 30 + language.RIDGE * inner, cross[:90].T @ y / 30, rcond=1e-9)[0]
        assert np.abs(np.clip((cross @ w + 1) / 2, 0, 1) - model.scores(x)[:, k]).max() < 1e-3
    assert [model.languages[i] for i in model.scores(x[:90]).argmax(1)] == labels


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_levenshtein():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(2))
        m = toxicity.Levenshtein(a, 2)
        s = m.start()
        for c in b:
            s = m.step(s, c)
        assert (m.edits(s) if m.edits(s) is not None else 9) == (edits(a, b) if edits(a, b) <= 2 else 9)


def test_near_words_are_all_found():
    rng = random.Random(8)
    terms = ["stupid", "worthless", "disgusting", "idiot", "réeuxment"]
    lex = toxicity.Lexicon(dict.fromkeys(terms, 2.0))
    words = []
    for _ in range(600):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            at, op = rng.randrange(len(w) + 1), rng.randrange(3)
            if op == 0:
                w.insert(at, rng.choice("abé"))
            elif w[at : at + 1]:
                w[at : at + 1] = rng.choice("xyzé") if op == 1 else ""
        words.append("".join(w))
    found = {(r, t, e) for r, t, e, _, _ in toxicity.hits(lex, pa.array(words))}
    for k, w in enumerate(words):
        near = sorted((edits(w, t), t) for t in terms if edits(w, t) <= toxicity.allowed_edits(t))
        assert {(k, near[0][1], near[0][0])} <= found if near else k not in {r for r, _, _ in found}


def test_scores_by_brute_force():
    """Every text's score from its words one by one: nearest term, context and the regression's weights."""
    lex = toxicity.Lexicon({"idiot": 3.0, "worthless": 2.0, "scum": 2.5})
    weights = np.array([0.7, 0.4, -0.3, 0.2, -2.0])
    rng, pool = random.Random(12), ["idiot", "idi0t", "worthles", "wortless", "scum", "scam", "you", "said", "and", "the", "\u201cidiot\u201d", '"worthless"', "mill"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(200)]
    want = []
    for t in texts:
        raw = low(t).encode()
        spans = [m.span() for m in re.finditer(rb"[0-9a-zA-Z\x80-\xff]+", raw)]
        words, f = [raw[a:b] for a, b in spans], [0.0] * 4
        for k, w in enumerate(words):
            word = w.decode("utf-8", "replace")
            near = sorted((edits(word, x), x) for x in lex.weight if edits(word, x) <= toxicity.allowed_edits(x))
            if not near:
                continue
            quote, to = toxicity.context(raw, words[max(0, k - toxicity.WINDOW) : k], words[k + 1 : k + 1 + toxicity.WINDOW], *spans[k])
            x = lex.weight[near[0][1]] * (1 - 0.8 * quote) * (1 + 0.5 * to) * 0.7 ** near[0][0]
            f = [f[0] + x, max(f[1], x), f[2] + quote, f[3] + to * (1 - quote)]
        want.append(1 / (1 + math.exp(-(sum(math.log1p(v) * w for v, w in zip(f, weights, strict=False)) + weights[-1]))))
    assert np.abs(toxicity.Model(lex, weights).scores(pa.array(texts)) - np.array(want)).max() < 1e-9


def test_context_windows():
    lex = toxicity.Lexicon({"idiot": 3.0})
    quoted, plain, you = toxicity.features(lex, pa.array(['he said "idiot" is a word', "a idiot here", "you idiot"]))[:, 0]
    assert quoted < plain < you


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(10**6, None, None, None, 0), (10**6 + 1, "", None, None, 0), (None, "idiot", None, None, 0)], docs.schema)
    got = toxicity.detect(docs.unionByName(odd), labels).join(labels, "doc_id", "left").collect()
    assert len(got) == docs.count() + 3
    assert sum(r.predicted for r in got if r.toxic == 0) == 0
    assert sum(r.predicted for r in got if r.toxic == 1) >= 20
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
