"""Operators on documents against brute force, on a small table and on odd rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontam, jaccard, licenses, lm, mixing, packing, pii, quality

WORD = re.compile(r"[^\x20\x09-\x0d]+").findall
ascii_lower = lambda t: (t or "").encode().lower().decode()


def table(spark, sf, name="documents"):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- licence scans


def test_license_base(spark, sf, odd):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    for docs in (table(spark, sf).select("doc_id", "text"), odd.select("doc_id", "text")):
        want = []
        for r in docs.collect():
            w = split(ascii_lower(r["text"]))
            hits = [(k, label) for label, p in phrases.items() for k in range(len(w)) if w[k : k + len(p)] == p]
            want.append((r["doc_id"], len(w), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None, ",".join(sorted({x for _, x in hits}))))
        got = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan_documents(docs).collect()]
        assert Counter(got) == Counter(want)


def test_license_rules_are_many_and_gated():
    every = [r for rs in licenses.rules().values() for r in rs]
    assert len(every) > 200
    for r in every:  # a keyword that the regex can't match without would hide the rule's places from nothing, but must be a word
        assert re.fullmatch(r"[a-z0-9]+", r.keyword)


def test_license_suppression():
    n, base, first, last, named, labels, score, found = licenses.scan("licensed under the apache license version 2 0 and the mit license")
    assert (n, base, first, last, named) == (12, 2, 3, 10, "apache,mit")
    assert labels == "apache,apache-2.0,mit" and 0 < score <= 1
    assert [(d["label"], d["first"], d["last"]) for d in found] == [("apache-2.0", 0, 7), ("mit", 9, 11)]


def phrases(tree):
    """One text for each way through a regex: every branch and character of a class, optional parts with and without."""
    out = [""]
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            new = [chr(arg)]
        elif op == "IN":
            new = [c for o, a in arg for c in ([chr(a)] if str(o) == "LITERAL" else map(chr, range(a[0], a[1] + 1)))]
        elif op == "ANY":
            new = ["x"]
        elif op == "SUBPATTERN":
            new = phrases(arg[3])
        elif op == "BRANCH":
            new = [x for t in arg[1] for x in phrases(t)]
        else:
            assert op in ("MAX_REPEAT", "MIN_REPEAT")
            low, _, inner = arg
            one = phrases(inner)
            new = [""] * (low == 0) + (one if low <= 1 else [one[0] * low])
        out = [a + b for a in out for b in new]
    return out


def test_license_gate_hides_nothing():
    """On every phrase that a rule's regex takes, the rules behind their keywords find what all rules find."""
    from graphloom.llm.license_rules import RULES

    every = {r.order: r for rs in licenses.rules().values() for r in rs}
    for k, line in enumerate(x for x in RULES.splitlines() if x.strip()):
        for phrase in phrases(re._parser.parse(line.split("|", 3)[3].strip())):
            words = phrase.split()
            found = {(p.start, p.stop, p.rule.order) for p in licenses.places(words, licenses.rules())}
            assert any(order == k for _, _, order in found), phrase
            assert found == {(p.start, p.stop, p.rule.order) for p in licenses.places([*words], {w: tuple(every.values()) for w in words})}, phrase


def test_suppression_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        places = []
        for k in range(25):
            s = int(rng.integers(0, 30))
            places.append(licenses.Place(s, s + int(rng.integers(1, 12)), licenses.Rule(k, int(rng.integers(1, 4)), False, "", "", None)))
        kept = []
        for p in sorted(places, key=lambda p: (-p.rule.priority, p.start - p.stop, p.start, p.rule.order)):
            if not any(q.start <= p.start and p.stop <= q.stop for q in kept):
                kept.append(p)
        assert {p.rule.order for p in licenses.suppress(places)} == {p.rule.order for p in kept}


# ---- Jaccard join


def brute_components(rows):
    sets, up = [], {}
    for d, t in rows:
        w = WORD(ascii_lower(t))
        sets.append((d, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
        up[d] = d

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    known = [x for x in sets if x[0] is not None]
    where = defaultdict(list)
    for k, (_, s) in enumerate(known):
        for x in s:
            where[x].append(k)
    for k, (d, s) in enumerate(known):
        for j in {j for x in s for j in where[x] if j < k}:
            o = len(s & known[j][1])
            if 100 * o >= 80 * (len(s) + len(known[j][1]) - o):
                a, b = find(d), find(known[j][0])
                up[max(a, b)] = min(a, b)
    return Counter((d, len(s), find(d) if d is not None else None) for d, s in sets)


@pytest.mark.parametrize("block", [3000, 3])
def test_jaccard_equals_brute_force(spark, sf, odd, block):
    """A block of three sends every larger cluster through the pivots and the search in blocks."""
    rng = np.random.default_rng(4)
    made = []
    for g in range(4):
        base = [f"g{g}t{k}" for k in range(80)]
        for _ in range(9):
            w = list(base)
            for k in rng.choice(80, int(rng.integers(0, 4)), replace=False):
                w[k] = f"n{rng.integers(0, 10**9)}"
            made.append((1000 + len(made), " ".join(w)))
    docs = table(spark, sf).select("doc_id", "text").filter("doc_id < 120").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(made, "doc_id long, text string")).cache()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    # the odd rows reuse ids of the table; rows that share an id are one document
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link_components(docs, jaccard.JaccardParams(block=block)).collect())
    assert got == brute_components(rows)


def test_divide_skip():
    rng = np.random.default_rng(2)
    for _ in range(40):
        lists = [sorted(set(rng.integers(0, 30, rng.integers(1, 20)).tolist())) for _ in range(25)]
        holders, start = np.concatenate([np.array(x) for x in lists]), np.r_[0, np.cumsum([len(x) for x in lists])]
        of = np.flatnonzero(rng.random(25) < 0.9)
        c = Counter(x for k in of for x in lists[k])
        for need in (1, 5, 12, 20):
            want = sorted((k, n) for k, n in c.items() if n >= need)
            for heap in (0, 4096):
                for long in (1, 10, 64):
                    got = jaccard.divide_skip(holders, start, of, need, heap=heap, long=long)
                    assert list(zip(*(x.tolist() for x in got))) == want


def test_shingle_sets_tell_texts_apart_as_words_do():
    """Equal words in whatever case give equal sets; texts, nulls and slices of a column don't touch each other."""
    import pyarrow as pa

    from graphloom.llm.shingles import shingle_sets, word_hashes

    rng = np.random.default_rng(9)
    alphabet = ["a", "B", "b", "\t", " ", "\n", "é", "日", "\x1c", "\u2003", "x" * 70, "X" * 70, "1"]
    made = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(300)] + [None, "", " ", "a b c d e f"]
    for column in (pa.array(made), pa.array(["zz", *made]).slice(1), pa.array(made, pa.large_string())):
        names, at = word_hashes(column)
        flat, ends = shingle_sets(column)
        known: dict = {}
        for k, t in enumerate(made):
            w = WORD(ascii_lower(t))
            own = names[at[k] : at[k + 1]].tolist()
            assert len(own) == len(w) and all(known.setdefault(x, h) == h for x, h in zip(w, own))
            want = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
            got = flat[ends[k] : ends[k + 1]].tolist()
            assert len(got) == len(want) and got == sorted(got)
            assert all(known.setdefault(x, None) is None for x in want) and known.setdefault(frozenset(want), got) == got
        assert len(set(h for h in known.values() if isinstance(h, int))) == sum(isinstance(h, int) for h in known.values())


def test_packed_numbers():
    from graphloom.llm.jaccard import pack, unpack

    rng = np.random.default_rng(1)
    for v in ([], [0], [65534, 65535, 65536, 131069, 131070, 131071], [0, 2**32 - 1], np.unique(rng.integers(0, 2**29, 20000)), np.unique(rng.integers(0, 2**16, 500))):
        v = np.array(v, dtype=np.int64)
        assert unpack(*pack(v)).tolist() == v.tolist()


def test_jaccard_empty(spark):
    assert jaccard.link_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# ---- mixing


def test_mixing(spark, sf, odd):
    for docs in (table(spark, sf).select("doc_id", "source", "text"), odd):
        rows = [r.asDict() for r in mixing.mix_report(docs).collect()]
        size = defaultdict(int)
        for r in docs.collect():
            size[r["source"]] += len(WORD(r["text"] or ""))
        order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
        weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
        capped: set = set()
        total = sum(size.values())
        while True:
            free = [s for s in order if s not in capped]
            left = total - sum(3 * size[s] for s in capped)
            target = {s: 3 * size[s] for s in capped} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            over = {s for s in free if target[s] > 3 * size[s]}
            if not over:
                break
            capped |= over
        taken, largest = defaultdict(int), defaultdict(int)
        for r in rows:
            assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * (1 + target[r["source"]])
            assert 0 <= r["taken"] <= 3 * r["size"]
            taken[r["source"]] += r["taken"]
            largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert len(rows) == docs.count()
        for s in order:
            assert taken[s] <= target[s] + 1 and taken[s] >= target[s] - max(1, largest[s])
        again = sorted((str(r["doc_id"]), r["taken"]) for r in mixing.mix_report(docs.repartition(5)).collect())
        assert again == sorted((str(r["doc_id"]), r["taken"]) for r in rows)
    assert mixing.mix_documents(odd).columns == odd.columns


def clashing(odd):
    """The odd rows with columns named as the stages might name their own."""
    for k, c in enumerate(["measured", "fences", "group_lang", "group_source", "row", "part", "copies", "idx", "key", "kappa", "rounds", "s", "h", "_size", "_copy", "_lang", "component", "rep"]):
        odd = odd.withColumn(c, F.lit(k))
    return odd


def test_stages_bear_clashing_names_and_empty_tables(spark, odd):
    odd = clashing(odd)
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    for stage in (quality.keep_documents, jaccard.drop_near_copies, lambda d: decontam.clean_documents(d, bench), mixing.mix_documents):
        left = stage(odd)
        assert left.columns == odd.columns and {r["_copy"] for r in left.collect()} <= {14}
        assert stage(odd.limit(0)).collect() == [] and stage(odd.limit(0)).columns == odd.columns


def test_one_row_stays_of_near_copies(spark):
    near = " ".join(f"w{k}" for k in range(60))
    rows = [(1, near, "a"), (1, near, "a"), (2, near, "b"), (3, near + " more", "c"), (4, "other words", "d"), (4, "quite other words", "d"), (None, near, "e"), (None, near, "e"), (5, None, "f"), (6, "", "g")]
    left = jaccard.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, row string"))
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter([(1, near), (4, "other words"), (4, "quite other words"), (None, near), (None, near), (5, None), (6, "")])


def test_mixing_of_rows_with_null_or_equal_ids(spark):
    """Rows that can't be told apart by id are taken one by one, so sources come near their targets, and the texts agree with the report."""
    rows = [(None, f"{k} " * 10, "a") for k in range(50)] + [(None, "same text of ten words as all the others are", "b")] * 50 + [(7, f"{k} x " * 5, "c") for k in range(50)] + [(8, "t " * 10, "c")] * 2500
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    report = mixing.mix_report(docs).collect()
    taken, target = Counter(), {}
    for r in report:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert len(report) == len(rows) and all(target[s] - 10 <= taken[s] <= target[s] + 1 for s in "abc")
    want = Counter()
    for r in report:
        want[r["source"], r["doc_id"]] += r["copies"]
    assert Counter((r["source"], r["doc_id"]) for r in mixing.mix_documents(docs).collect()) == Counter({k: n for k, n in want.items() if n})


def test_mixing_solves_the_odds_of_nearly_equal_sizes(spark):
    """Nearly all words of a source whose documents hardly differ in size: the scale solves sum(min(1, kappa s) s) = rest."""
    size = np.random.default_rng(8).integers(100, 121, 2000)
    rest = int(0.99 * size.sum())
    sizes = spark.createDataFrame([(0, int(s)) for s in size], "idx int, size long")
    kappa = mixing._odds_scale(sizes, spark.createDataFrame([(0, rest)], "idx int, rest long"), mixing.MixParams()).first()["kappa"]
    assert abs((np.minimum(1, kappa * size) * size).sum() - rest) < 1e-3 * rest


# ---- quality


def test_quality_metrics(spark, sf, odd):
    def brute(t):
        t = t or ""
        w = WORD(t)
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if WORD(x)]
        return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered)

    for docs in (table(spark, sf), odd):
        for r in quality.with_metrics(docs.select("doc_id", "text")).collect():
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(r["text"])
    assert quality.judge(odd).count() == odd.count()
    assert quality.keep_documents(odd).columns == odd.columns
    assert quality.judge(odd.limit(0)).count() == 0


def test_quality_keeps_clean_documents(spark):
    """Labelled rows: hardly any good document goes but for the base rules, and most junk goes."""
    sf = "/root/testdata/sf0.01"
    r = quality.op6_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    good, bad = r.filter("quality = 1 AND NOT base_failed"), r.filter("quality = 0")
    assert good.filter("kept").count() >= 0.99 * good.count() and bad.filter("NOT kept").count() >= 0.9 * bad.count()


# ---- decontamination


def test_decontamination_finds_planted_passages(spark):
    words = [f"word{k}" for k in range(400)]
    rng = np.random.default_rng(3)
    say = lambda n: [words[k] for k in rng.integers(0, 400, n)]
    items = [(k, " ".join(say(int(rng.integers(15, 50))))) for k in range(30)]
    docs, truth = [], set()
    for d in range(300):
        w = say(200)
        if d % 10 == 0:
            k = d // 10 % 30
            passage = items[k][1].split()
            if d % 20 == 0:  # a paraphrase: one word in six is another
                passage = [x if j % 6 else "other" for j, x in enumerate(passage)]
            at = int(rng.integers(0, 200))
            w[at:at] = passage
            truth.add((d, k))
        docs.append((d, " ".join(w)))
    docs += [(1000, None), (1001, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (None, "x y z"), (99, None)], "item_id long, text string")
    p = decontam.DecontamParams(common=0.6)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(frame, bench, p).collect()}
    assert len(got & truth) >= 0.9 * len(truth) and not got - truth
    left = decontam.clean_documents(frame, bench, p)
    assert left.columns == frame.columns and left.count() == frame.count() - len({d for d, _ in got})
    assert decontam.contaminated(frame, bench.limit(0), p).count() == 0


def test_decontamination_finds_a_frequent_paraphrase(spark):
    """Words kept by a paraphrase in a third of the documents weigh nothing, at production parameters."""
    rng = np.random.default_rng(6)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(n))) for k, n in enumerate((20, 33, 64, 100))]
    docs, truth = [], set()
    for d in range(300):
        w = [f"b{x}" for x in rng.integers(0, 5000, 120)]
        if d % 3 == 0:
            for k, text in items:
                w += [x if j % 6 else "other" for j, x in enumerate(text.split())] + [f"b{x}" for x in rng.integers(0, 5000, 20)]
                truth.add((d, k))
        docs.append((d, " ".join(w)))
    for k, text in items:  # the words that the paraphrase replaces are rare, and keep their weight
        docs.append((1000 + k, " ".join(text.split()[::6])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == truth


def test_decontamination_fits_on_all_documents(spark):
    """The bases diagonalise the products of all windows of all documents and the passages, as counted by brute force."""
    rng = np.random.default_rng(8)
    items = [(k, " ".join(f"{'c' if j % 3 else 'r'}{x}" for j, x in enumerate(rng.integers(0, 12, 30)))) for k in range(4)]
    texts = [None, "", "nothing here", *(" ".join([f"r{x}" for x in rng.integers(0, 12, 2)] * (d % 40 == 0) + [f"c{x}" for x in rng.integers(0, 12, int(rng.integers(1, 9)))]) for d in range(9000))]
    texts.append(" ".join(f"{'r' if x > 5 and j % 9 == 0 else 'c'}{x}" for j, x in enumerate(rng.integers(0, 12, 3000))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    p = decontam.DecontamParams()
    ((bench, idfs, bases),) = decontam.searches(docs, spark.createDataFrame(items, "item_id long, text string"), p)
    names, n = sorted({w for _, t in items for w in t.split()}), len(texts)
    held = Counter(w for t in texts for w in set((t or "").split()) if w in names)
    rows = [t.split()[a : a + 48] for t in texts if t for a in range(0, len(t.split()), 48)]
    number = dict(zip(names, decontam.Lookup(bench.terms)(decontam.word_hashes(decontam.pa.array([" ".join(names)], decontam.pa.large_string()), punctuation=False)[0])))
    common = {w for w in names if held[w] > p.common * n}
    assert 0 < len(common) < len(names) and all((idfs[1][number[w]] > 0) == (w in common) for w in names)
    for idf, basis in zip(idfs, bases):
        want = np.zeros((len(names), len(names)))
        for words, times in [(r, 1) for r in rows] + [(t.split(), max(30, n / 100)) for _, t in items]:
            v = np.zeros(len(names))
            np.add.at(v, [number[w] for w in words if w in number], 1)
            v, norm = v * idf, (v * idf**2).sum()
            if norm:
                want += times * np.outer(v, v) / norm
        got = basis.T @ want @ basis
        assert basis.shape == want.shape and np.abs(got - np.diag(np.diag(got))).max() < 1e-4 * np.abs(want).max()


def test_lcs():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 6, 20), rng.integers(0, 6, 25)
        t = np.zeros((21, 26), int)
        for i in range(20):
            for j in range(25):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontam.lcs(a, b) == t[20, 25]


def test_decontamination_filters_windows_by_the_words_they_hold():
    """Just the windows pass that hold enough of a passage's words, a word as often as the passage has it, however often the window does."""
    rng = np.random.default_rng(4)
    p = decontam.DecontamParams()
    bench = decontam.Bench.build([(k, " ".join(f"w{x}" for x in rng.integers(0, 40, n))) for k, n in enumerate([9, 30, 60, 64])], p)
    n = len(bench.terms)
    search = decontam.Search(bench, [np.ones(n), np.zeros(n)], [np.eye(n), np.eye(n)], p)
    ids = np.where(rng.random(16 * 2000) < 0.6, -1, np.minimum(rng.geometric(0.08, 16 * 2000) - 1, n - 1)).astype(np.int32)
    ids[:16] = bench.words[0][0]  # one word of the passage, many times
    for size, many in ((2, 1500), (5, 1500), (5, 20)):
        begin = np.r_[0, rng.choice(1990, many, replace=False)]
        passage = rng.integers(0, 4, len(begin))
        passage[0] = 0
        got = search._enough(ids, search._postings(ids), begin, size, passage)
        for start, m, kept in zip(begin.tolist(), passage.tolist(), got.tolist()):
            there = set(ids[start * 16 : (start + size) * 16].tolist())
            held = sum(x in there for x in search.lists[m])
            assert kept == (held >= (p.near_share if search.answers[m] <= there else p.share) * len(search.lists[m]))
        assert got.any() and not got.all()


# ---- language model


def test_lm_scores(spark, sf, odd):
    from zlib import crc32

    docs = table(spark, sf).select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = [(r["doc_id"], WORD(ascii_lower(r["text"]))) for r in docs.collect()]
    held = lambda d: crc32(("" if d is None else str(d)).encode()) % 10 == 0
    c = Counter()
    for d, w in rows:
        if not held(d):
            c.update(w)
            c["\x00end"] += 1
    n, v = sum(c.values()), len(c)
    log = lambda w: np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1)))
    want = Counter((d, held(d), len(w) + 1, sum(c[x] > 0 for x in [*w, "\x00end"]), n, round(sum(map(log, [*w, "\x00end"])), 4)) for d, w in rows)
    got = lm.score_documents(docs, lm.LmParams(head=500, warm_epochs=1)).collect()  # a short head sends many words through the join
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_lm_learns_from_whole_texts(spark):
    """Every subword is a target of the windows, and texts that differ only far from their start give different weights."""
    path, encode = "", lm.Encoder("")
    classes = lm.class_of_ids(np.zeros(lm.VOCABULARY), [encode.piece(k) for k in range(lm.VOCABULARY - 1)] + [b""], 2)
    k = int(classes.max()) + 1
    sub = lm.Subwords.build(np.zeros(lm.VOCABULARY), np.zeros((k, lm.VOCABULARY)), classes, 50, 0.1)
    texts = ["", "one", "the whole of it " * 5000]
    x, y = lm.all_windows(texts, sub, encode)
    assert (y >= 0).sum() == sum(len(encode(" " + " ".join(t.split()))) + 1 if t else 1 for t in texts) and x.shape == y.shape

    def weights(tail):
        rows = spark.createDataFrame([(0, "one two three " * 100 + tail)], "seed long, text string")
        return sub.shape.pack(lm.fit(rows, 1, sub, lm.LmParams(warm_epochs=1, vocabulary=path)))

    assert np.abs(weights("red blue " * 50) - weights("cat 1234 " * 50)).max() > 1e-4


def test_lm_ids_of_many_texts_equal_those_of_each():
    """Words whose ids are kept give the ids of the whole text, whatever white space is part of a word; so do the words one by one."""
    encode = lm.Encoder("")
    rng = np.random.default_rng(2)
    alphabet = list("abst'12.,é中 \x1c\x85\u3000") + ["'s", " the", "ll", "\u00a0 "]
    texts = [lm.words_of("".join(rng.choice(alphabet, n))) for n in [0, 1, *rng.integers(2, 60, 400), 0]]
    want = [encode(" " + " ".join(t)) if t else [] for t in texts]
    ids = lm.WordIds(encode, limit=50)
    for k in range(0, len(texts), 40):  # what is kept is thrown away in between
        got, counts = ids(texts[k : k + 40])
        assert got.tolist() == [x for w in want[k : k + 40] for x in w] and counts.tolist() == [len(w) for w in want[k : k + 40]]
    words = sorted({w for t in texts for w in t})
    got, owner = lm.Pieces(encode)(words)
    assert all(got[owner == k].tolist() == encode(" " + w) for k, w in enumerate(words))


def test_lm_words_are_coded_once_a_batch(spark):
    """Words come as numbers of distinct ones, cut as by words_of, and only distinct ones are looked up; counts handed out early add up."""
    import pyarrow as pa

    from graphloom.llm.common import slices

    rng = np.random.default_rng(4)
    alphabet = list("abAB \t\n\x0b\x0c\r\x1c\x85É中\u3000\x00")
    texts = ["", " ", None, "one", " two  two ", *["".join(rng.choice(alphabet, n)) for n in rng.integers(1, 80, 300)], "\n"]
    want = [lm.words_of(ascii_lower(t)) for t in texts]
    for column in (pa.array(texts), pa.array(["sliced off", *texts]).slice(1), pa.array([None, ""], pa.string())):
        words = lm.Words.of(column)
        distinct = lm.strings(words.distinct)
        got = [[distinct[c] for c in words.codes[a:b]] for a, b in zip(words.edges, words.edges[1:])]
        assert got == (want if len(column) > 2 else [[], []]) and len(distinct) == len(set(distinct))
    cut = list(slices(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), 0, 100))
    groups = list(lm.grouped(iter(cut), 0, 1000))
    assert len(cut) > len(groups) > 10 and [x for parts, _ in groups for x in parts] == cut
    runs = [run for parts, words in groups for run in words.parts([x.num_rows for x in parts])]
    assert [run.counts.tolist() for run in runs] == [[len(lm.words_of(ascii_lower(t))) for t in x.column(0).to_pylist()] for x in cut]
    encode = lm.Encoder("")
    plain = sorted({w for t in want for w in t if w.split() == [w]})
    for limit in (20, 1 << 18):  # what is kept, but for the head, is thrown away in between, or never
        asked, ids = [], lm.WordIds(encode, limit, lm.Coded.of(pa.array(plain[::2]), lm.Pieces(encode)))
        for parts, words in groups:
            ids.pieces.encode = lambda text: (asked.append(text), encode(text))[1]
            numbers = ids.numbers(words)
            ids.pieces.encode = encode
            for part, run in zip(parts, words.parts([x.num_rows for x in parts])):
                got, counts = ids(run, numbers)
                each = [lm.words_of(ascii_lower(t)) for t in part.column(0).to_pylist()]
                each = [encode(" " + " ".join(t)) if t else [] for t in each]
                assert got.tolist() == [x for t in each for x in t] and counts.tolist() == [len(t) for t in each]
    asked = Counter(w for t in asked for w in t[1:].split(" ") if w)
    assert set(asked) == set(plain[1::2]) and set(asked.values()) == {1}
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    c = Counter(w for t in want for w in t) + Counter({lm.END: len(texts)})
    for limit in (3, 400_000):
        assert {r["word"]: r["c"] for r in lm.word_counts(rows, limit).collect()} == c


def test_attention_trains_on_each_block_once():
    """Blocks that share their keys have the gradient of the windows they make, also where scores are too high for exp; a run's targets are scored once."""
    from graphloom.llm import attention
    from graphloom.llm.attention import NAMES, Shape, block_gradient, gradient

    s = Shape(12, 5, width=4, block=4)
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 12, (40, 4)), rng.integers(-1, 5, (40, 4))
    for more in (0, 800):
        w = {k: v.astype(np.float64) + (more if k == "dist" else 0) for k, v in s.init(1).items()}
        loss, g = block_gradient(s, w, x, y)
        plain, h = gradient(s, w, (np.concatenate([x[:-1], x[1:]], axis=1), np.concatenate([y[:-1], y[1:]], axis=1)))
        assert np.isclose(loss, plain) and all(np.isfinite(g[k]).all() and np.allclose(g[k], h[k]) for k in NAMES)
    seen, step = [], attention.block_gradient
    try:
        attention.block_gradient = lambda *a: (seen.append(int((a[3] >= 0).sum())), step(*a))[1]
        attention.train(s, s.init(1), x, y, 0.01, batch=16)
    finally:
        attention.block_gradient = step
    assert len(seen) > 1 and sum(seen) == (y[1:] >= 0).sum()


def test_attention_gradient_and_batches():
    from graphloom.llm.attention import NAMES, Scorer, Shape, gradient

    s = Shape(12, 5, width=4, block=4)
    w = {k: v.astype(np.float64) for k, v in s.init(1).items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 12, (3, 8)), rng.integers(-1, 5, (3, 8))
    loss, g = gradient(s, w, (x, y))
    for k in NAMES:
        at = tuple(rng.integers(0, n) for n in w[k].shape)
        up, down = {**w, k: w[k].copy()}, {**w, k: w[k].copy()}
        up[k][at] += 1e-4
        down[k][at] -= 1e-4
        slope = (gradient(s, up, (x, y))[0] - gradient(s, down, (x, y))[0]) / 2e-4
        assert abs(slope - np.asarray(g[k])[at]) < 2e-3
    # a change in a later symbol leaves earlier scores alone
    score = Scorer(s, s.init(1))
    a = rng.integers(0, 12, (4, 4))
    b = a.copy()
    b[2, 3] = (b[2, 3] + 1) % 12
    first, t = np.array([True, False, False, True]), rng.integers(0, 5, (4, 4))
    one, two = score(a, first, t), score(b, first, t)
    assert np.allclose(one[:2], two[:2]) and np.allclose(one[2, :3], two[2, :3]) and np.allclose(one[3], two[3]) and not np.allclose(one[2, 3], two[2, 3])


# ---- packing


def test_packing_is_lossless(spark, sf, odd):
    docs = table(spark, sf).select("doc_id", "text").unionByName(odd.select("doc_id", "text").filter("doc_id <> 5"))
    p = packing.PackParams(row=256, block=20_000)
    encode = packing.Encoder()
    pieces = defaultdict(list)
    for r in packing.pack_documents(docs, p).collect():
        ids, place, cu = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2"), r["cu_seqlens"]
        assert len(ids) == 256 and cu[0] == 0 and cu[-1] == r["n_tokens"] <= 256 and len(cu) == r["n_segments"] + 1
        for a, b, d, s in zip(cu, cu[1:], r["doc_ids"], r["starts"]):
            assert place[a:b].tolist() == list(range(b - a))
            pieces[d].append((s, ids[a:b].tolist()))
        assert (ids[cu[-1] :] == p.end_id).all()
    whole = defaultdict(list)
    for r in docs.collect():
        whole[r["doc_id"]].append([*encode(r["text"] or ""), p.end_id])
    for d, texts in whole.items():
        got = sorted(pieces[d])
        if len(texts) == 1:
            assert [x for _, part in got for x in part] == texts[0]
        else:
            assert sum(len(x) for _, x in got) == sum(map(len, texts))


def test_best_fit_decreasing_equals_plain_search():
    rng = np.random.default_rng(7)
    for _ in range(20):
        sizes = rng.integers(1, 65, 200)
        rows = packing.best_fit_decreasing(sizes, 64)
        assert sorted(k for r in rows for k in r) == list(range(200)) and all(sizes[r].sum() <= 64 for r in rows)
        left: list[int] = []
        for n in sorted(sizes.tolist(), reverse=True):
            fit = [x for x in left if x >= n]
            if fit:
                left.remove(min(fit))
                left.append(min(fit) - n)
            else:
                left.append(64 - n)
        assert len(rows) == len(left)


def test_plain_pattern_cuts_alike():
    encode = packing.Encoder()
    for t in ("It's 3 o'clock, isn't it?", "a b\nc", " lead", "tail ", "ünï 12ab", "x\ty", "\n"):
        assert encode._plain(t) == encode._full(t)


def test_binary_shards(spark, sf, tmp_path):
    packed = packing.pack_documents(table(spark, sf).limit(40), packing.PackParams()).cache()
    m = packing.write_packed(packed, f"file://{tmp_path}").collect()
    assert sum(r["n_rows"] for r in m) == packed.count()
    total = sum(len(np.fromfile(r["path"] + ".ids", "<u2")) for r in m)
    assert total == packed.count() * 2048


# ---- pseudonyms


def test_feistel_is_a_permutation():
    for size in (1, 2, 7, 100, 1000):
        f = pii.Feistel(pii.PiiParams(), "t", size)
        got = [f(x) for x in range(size)]
        assert sorted(got) == list(range(size)) and [f.undo(x) for x in got] == list(range(size))


def test_pseudonyms_keep_format_and_links(spark, odd):
    p = pii.PiiParams(b"k")
    text = "Pay 4012 8888 8888 1881 or 4012888888881881 to jo.doe7@mail.example.com by 2024-02-29, call +1 (988) 555-2485, from 55.63.178.142, ssn 123-45-6789, GB82 WEST 1234 5698 7654 32"
    new, kinds = pii.pseudonymize(text, p)
    assert sorted(kinds) == sorted(["card", "card", "email", "date", "phone", "ip", "ssn", "iban"])
    for secret in ("4012 8888", "jo.doe7", "2024-02-29", "555-2485", "55.63.178", "123-45-6789", "1234 5698"):
        assert secret not in new
    cards = re.findall(r"(?:\d{4} ?){4}", new)
    assert cards[0].replace(" ", "") == cards[1].strip() and pii.luhn_digit(cards[1].strip()[:-1]) == cards[1].strip()[-1]
    assert pii.pseudonymize(new, p, undo=True)[0] == text
    assert pii.pseudonymize(text, pii.PiiParams(b"other"))[0] != new


def test_invalid_values_stay():
    for text in ("4012888888881882", "2023-02-30", "300.1.1.1", "000-12-3456", "version 2.0", "GB00 WEST 1234 5698 7654 32", "no data here"):
        assert pii.pseudonymize(text) == (text, [])


def test_pseudonyms_of_odd_rows(spark, odd):
    got = {(r["doc_id"], r["text"]) for r in pii.pseudonymize_documents(odd).collect()}
    assert (1, None) in got and (2, "") in got


def test_pii_values_followed_or_preceded_by_others():
    """A valid value is found though its pattern could take in more, or fails at an earlier place that overlaps it."""
    for value, text in [
        ("4111 1111 1111 1111", "4111 1111 1111 1111 12/26"), ("4012888888881881", "4012888888881881 123"), ("4111 1111 1111 1111", "1234 4111 1111 1111 1111 end"),
        ("4111-1111-1111-1111", "4111-1111-1111-1111-1226-99"), ("BE68 5390 0754 7034", "BE68 5390 0754 7034 BIC"), ("AT61 1904 3002 3457 3201", "AT61 1904 3002 3457 3201 AND"),
        ("BE68 5390 0754 7034", "AB13 BE68 5390 0754 7034 end"),
    ]:
        new, kinds = pii.pseudonymize(text)
        before, after = text.split(value)
        assert value not in new and new.startswith(before) and new.endswith(after) and len(new) == len(text), text
        assert len(kinds) == 1 and pii.pseudonymize(value)[0] == new[len(before) : len(new) - len(after)]


def test_scorer_takes_rows_of_one_table_for_each_use():
    """Queries, keys and values come from rows of their own, as long as a vector, and give what plain attention gives."""
    from graphloom.llm.attention import Scorer, Shape

    shape = Shape(9, 4, 8, 4)
    w = shape.init(2)
    w["dist"], w["bias"] = np.linspace(-1, 1, 8).astype(np.float32), np.linspace(0, 1, 4).astype(np.float32)
    score = Scorer(shape, w)
    assert [t.shape for t in score.tables] == [(9, 8)] * 4 and all(t.flags.c_contiguous for t in score.tables)
    x, y = np.random.default_rng(0).integers(0, 9, (3, 4)), np.random.default_rng(1).integers(0, 4, (3, 4))
    got = score(x, np.array([True, False, False]), y)
    for n in (1, 2):
        e = w["emb"][x[n - 1 : n + 1].ravel()]
        for i in range(4):
            seen = e[: 5 + i]
            a = np.exp(seen @ w["wk"] @ (e[4 + i] @ w["wq"]) / np.sqrt(8) + w["dist"][4 + i - np.arange(5 + i)])
            z = (e[4 + i] + a @ (seen @ w["wv"]) / a.sum()) @ w["out"] + w["bias"]
            assert abs(got[n, i] - (z - np.log(np.exp(z).sum()))[y[n, i]]) < 1e-4
