"""The ten operators against brute force, round trips and edge cases, on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery.llm import arc_warc, decontaminate, html_crf, hyperminhash, imatch, mixing, reply_trees, suffix_dedup, token_store, toxicity
from gleanery.storage import Tables

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, size string, a int"


def corpus(n=60, seed=3):
    """Copies, near copies, shared passages, empty, null and long texts; columns with names that operators use inside."""
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(400)]
    text = lambda k: " ".join(r.choices(words, k=k))
    passage = text(60)
    out = []
    for i in range(n):
        t = text(r.choice([1, 3, 4, 5, 30, 80, 200]))
        if out and i % 4 == 0:
            t = r.choice([x for _, x in out if x] or [t])
        elif out and i % 4 == 1:
            w = r.choice([x for _, x in out if x] or [t]).split(" ")
            for _ in range(max(1, len(w) // 40)):
                w[r.randrange(len(w))] = r.choice(words)
            t = " ".join(w)
        elif i % 4 == 2:
            t = f"{t}\n{passage} É {text(10)}"
        out.append((i * 3, t))
    out += [(1000, ""), (1001, None), (1002, " \t\n"), (1003, "Ab cd"), (1004, "aB CD"), (1005, "é" * 150 + "é" * 150), (1006, text(20_000))]
    return [(i, t, None if i % 5 == 0 else f"s{i % 3}", "x", 1) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def empty(docs):
    return docs.filter("false")


def test_mixing_targets_and_limits(spark, docs):
    got = mixing.mix(docs).collect()
    per = defaultdict(list)
    for r in got:
        assert r.mix_size == len(WORD.findall(r.text or "")) and r.mix_taken == r.mix_copies * r.mix_size <= 3 * r.mix_size
        per[r.source].append(r)
    order = sorted(per, key=lambda s: (s is None, s))
    size = {s: sum(r.mix_size for r in per[s]) for s in order}
    left, target, open_ = sum(size.values()), {}, {s: [1, 2, 3][k % 3] for k, s in enumerate(order)}
    while open_:
        level = left / sum(open_.values())
        over = [s for s in open_ if level * open_[s] > 3 * size[s]]
        if not over:
            target |= {s: level * w for s, w in open_.items()}
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
            del open_[s]
    for s in order:
        assert per[s][0].mix_source_size == size[s] and per[s][0].mix_target == pytest.approx(target[s])
        assert abs(sum(r.mix_taken for r in per[s]) - target[s]) <= max(r.mix_size for r in per[s]) / 2 + 1
    assert sorted((r.doc_id, r.mix_taken) for r in got) == sorted((r.doc_id, r.mix_taken) for r in mixing.mix(docs.repartition(3)).collect())
    assert mixing.mix(empty(docs)).count() == 0
    assert mixing.mixture(docs).count() == sum(r.mix_copies for r in got)


def test_mixing_reaches_a_skewed_target(spark):
    rows = [(i, "w " * (1 + i % 17), "big" if i % 3 else "small", "", 0) for i in range(9000)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).groupBy("source").agg(F.first("mix_target").alias("t"), F.sum("mix_taken").alias("k")).collect()
    assert all(abs(r.k - r.t) <= 1 for r in got)


def test_mixing_passes_over_documents_that_do_not_fit(spark):
    """30 words are wanted of one 60-word and forty 1-word documents."""
    rows = [(0, "w " * 60, "a", "", 0), *((i, "w", "a", "", 0) for i in range(1, 41))]
    rows += [*((i, "w w w", "b", "", 0) for i in range(100, 110)), *((i, "w w", "c", "", 0) for i in range(200, 210))]
    docs = spark.createDataFrame(rows, SCHEMA)
    for seed in range(4):
        got = mixing.mix(docs, seed=seed).groupBy("source").agg(F.first("mix_target").alias("t"), F.sum("mix_taken").alias("k")).collect()
        assert {r.source: r.k for r in got} == {"a": 30, "b": 60, "c": 60} and all(r.k == pytest.approx(r.t) for r in got)


def test_pareto_inclusion_follows_the_weights(spark):
    """Inclusion frequencies over many seeds against rates solved by brute force, with one certain document."""
    weight = {i: float(w) for i, w in enumerate([1] * 30 + [3] * 30 + [60], 1)}
    rows = [(i, "w w w w", "a", w) for i, w in weight.items()] + [(i, "w " * 400, "b", 1.0) for i in range(100, 103)] + [(200, "w " * 8, "c", None), (201, "w " * 8, "c", -1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, wish double").persist()
    seeds, seen = 8, Counter()
    for seed in range(seeds):
        got = mixing.mix(docs, weights=(1, 20, 1), seed=seed, weight_col="wish").collect()
        target = next(r.mix_target for r in got if r.source == "a")
        assert abs(sum(r.mix_taken for r in got if r.source == "a") - target) <= 2
        seen.update(r.doc_id for r in got if r.source == "a" and r.mix_copies)
    missing, sure = target, set()
    while True:
        rate = (missing - 4 * len(sure)) / sum(4 * w for i, w in weight.items() if i not in sure)
        more = {i for i, w in weight.items() if i not in sure and rate * w >= 1}
        if not more:
            break
        sure |= more
    assert sure == {61} and seen[61] == seeds
    for kind, ids in ((1, range(1, 31)), (3, range(31, 61))):
        assert sum(seen[i] for i in ids) / (30 * seeds) == pytest.approx(rate * kind, abs=0.09)


def test_crf_keeps_the_article_and_drops_the_rest(spark):
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><header><p>Site</p></header>
      <nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div>
      <article><h1>Title &amp; more</h1><p><b>First&nbsp; line<br>goes on. <p>Se<i>con</i>d.</p><script>var t="</p>";</script><p>All rights reserved.</p></article>
      <aside><p>Elsewhere there is more of this text to read.</p></aside><section id="comments"><div class="comment"><p>Nice text, I liked it a lot.</p></div></section>
      <form><label>Name</label><textarea>x</textarea></form><footer>&copy; 2020</footer>"""
    want = "Title & more\nFirst line goes on.\nSecond.\nAll rights reserved."
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, "u", page)]
    got = {r.page_id: r for r in html_crf.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == got[5].text == want and got[1].n_chars == len(want)
    assert all(got[k].text == "" and got[k].n_chars == 0 for k in (2, 3, 4))


@pytest.mark.parametrize("odd", ["<datalist><option value=a><option value=b></datalist>", "<object data=x>", "<select><option>one<option>two</select>", "<option>stray", "<template>", "<svg>", "<iframe src=x>"])
def test_nothing_is_lost_behind_an_odd_element(odd):
    body = "<article><h1>Title here</h1><p>This is the first paragraph of the text, and it is long enough.</p><p>And the second one follows it.</p></article>"
    want = "Title here\nThis is the first paragraph of the text, and it is long enough.\nAnd the second one follows it."
    texts = [b[0] for b in html_crf.leaf_blocks(f"<body>{odd}{body}</body>")]
    assert "\n".join(t for t in texts if t in want) == want and not {"one", "two", "stray"} & set(texts)


def test_crf_rows_of_odd_tables(spark):
    long = "<article><p>" + "</p><p>".join(f"Paragraph {i} of a very long article, with a full stop at the end." for i in range(20_000)) + "</p></article>"
    pages = spark.createDataFrame([(1, "u", long, "x", 1)], "page_id long, url string, html string, text string, n_chars int")
    got = html_crf.extract(pages).collect()
    assert len(got) == 1 and got[0].text.count("\n") == 19_999 and got[0].n_chars == len(got[0].text)
    assert html_crf.extract(pages.filter("false")).count() == 0


def test_crf_on_held_out_layouts():
    crf, good, n = html_crf.trained(), 0, 0
    for page, labels in html_crf.labelled_pages(150, seed=77):
        y = crf.decode(html_crf.leaf_blocks(page))
        assert len(y) == len(labels)
        good += sum(a == b for a, b in zip(y, labels, strict=True))
        n += len(y)
    assert good / n > 0.97


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p>Rain fell on the hills.</p></article>", "Rain fell on the hills."),
        (f"<article><p>{'Rain fell on the hills. ' * 9}</p><p>See <a href=/x>the other report on this</a></p></article>", ("Rain fell on the hills. " * 9).strip() + "\nSee the other report on this"),
        ("<div id=wrap><span>First line</span><div>text one<br><br>text two</div></div>", "First line\ntext one text two"),
        ("<article><p>&lt;&amp;&eacute;</p></article>", "<&é"),
        ("<div id=content><h2>News</h2><p>Rain fell on the hills.</p></div>", "News\nRain fell on the hills."),
        ("<article><p>Rain fell on the hills today.</p><p style='display:none'>Hidden words here.</p></article>", "Rain fell on the hills today."),
        ("<p>Rain fell.</p>", "Rain fell."),
        ("<nav><ul><li><a href=/>Home</a></ul></nav><footer>&copy; 2020</footer>", ""),
        ("<div class=cookie><p>We use cookies.</p></div>", ""),
        ("<form><label>Name</label><p>Fill it in.</p></form>", ""),
    ],
)
def test_plain_pages_have_a_text(page, want):
    assert html_crf.main_text(page, html_crf.trained()) == want


@pytest.mark.parametrize("family", html_crf.FAMILIES)
def test_crf_on_held_out_families(family):
    """Fitted without one kind of page, it labels most blocks of that kind."""
    rows = []
    for page, labels in html_crf.labelled_pages(300, seed=5, families=tuple(f for f in html_crf.FAMILIES if f != family)):
        rows.append(([html_crf.block_features(b) for b in html_crf.leaf_blocks(page)], labels))
        assert len(rows[-1][0]) == len(labels)
    crf, good, n = html_crf.Crf(), 0, 0
    crf.train(rows)
    for page, labels in html_crf.labelled_pages(100, seed=78, families=(family,)):
        y = crf.decode(html_crf.leaf_blocks(page))
        good += sum(a == b for a, b in zip(y, labels, strict=True))
        n += len(y)
    assert good / n > 0.94


def test_forced_labels_equal_brute_force():
    """A page without text gets the best of all label rows that have a free block as article."""
    from itertools import product

    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 7))
        crf = html_crf.Crf()
        crf.trans, crf.start = rng.normal(size=(2, 2)), rng.normal(size=2)
        scores = rng.normal(-3, 1, n).tolist()
        free = sorted(rng.choice(n, int(rng.integers(1, n + 1)), replace=False).tolist())
        value = lambda y: crf.start[y[0]] + sum(s for s, k in zip(scores, y, strict=True) if k) + sum(crf.trans[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, B905, E731
        best = max((y for y in product((0, 1), repeat=n) if any(y[k] for k in free)), key=value)
        assert crf._best_with(scores, free) == list(best)
        assert crf._best(scores) == list(max(product((0, 1), repeat=n), key=value))


def test_toxicity_learns_words_and_reads_clauses(spark):
    r = random.Random(2)
    words = ["".join(r.choices("laeiomkturns", k=r.randint(2, 8))) for _ in range(2000)]
    words = [w for w in words if w not in toxicity.Machine({}).fixed]  # no negation before an insult by chance
    plain = lambda k: " ".join(r.choices(words, k=k))
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        rows.append((i, plain(30) + (f" zarquon{r.choice('abcd')} " + plain(5) if bad else "") + "."))
        labels.append((i, int(bad)))
    rows += [(2000, None), (2001, "")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    assert all(got[i].predicted == (i % 5 == 0) for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1)
    assert all(0 <= got[i].score < 0.5 for i in (2000, 2001))
    kinds = lambda t: [k for _, own in toxicity.Machine({"moron": 1}).clauses(t) for k in own]
    assert kinds("you are a moron") == [toxicity.AIMED] and kinds("moron. you") == [toxicity.INSULT]
    assert kinds("not a moron") == [toxicity.NEGATED] and kinds("he said moron") == [toxicity.REPORTED]
    assert toxicity.AIMED_THREAT in kinds("i will kill you") and kinds("") == []
    again = toxicity.fit(docs.repartition(7), labels.repartition(5))
    assert again.insults == model.insults and (again.weights == model.weights).all()
    untrained = toxicity.fit(docs.filter("false"), labels.filter("false"))
    assert np.allclose(untrained.weights, toxicity.PRIOR)


def test_repeats_in_contexts_match_counts():
    r = random.Random(0)
    for _ in range(40):
        size = r.choice([3, 5, 8, 13])
        texts = [bytes(r.choice(b"ab\x00") for _ in range(r.randint(size, 40))) for _ in range(r.randint(1, 12))]
        count = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
        want = {(k, i) for k, t in enumerate(texts) for i in range(len(t) - size + 1) if count[t[i : i + size]] > 1}
        found = zip(*(x.tolist() for x in suffix_dedup.repeats_in_contexts(texts, np.ones(len(texts), np.int64), size)), strict=True)
        assert {(k, i) for k, a, b in found for i in range(a, b + 1)} == want
    many = suffix_dedup.repeats_in_contexts([b"abcdefgh", b"hgfedcba"], np.array([2, 1]), 6)
    assert [x.tolist() for x in many] == [[0], [0], [2]]  # what occurs twice as a whole


def test_prefix_values_match_the_sorted_rotations():
    r = random.Random(1)
    for length in (5, 9, 16):
        s = bytes(r.choice(b"ab") for _ in range(200)) + b"\xff"
        order, prefix = suffix_dedup.shared_prefixes(np.frombuffer(s, np.uint8), length)
        turned = [(s + s)[i : i + length] for i in order.tolist()]
        assert turned == sorted(turned)
        for k in range(1, len(turned)):
            same = next((i for i in range(length) if turned[k][i] != turned[k - 1][i]), -1)
            assert prefix[k] == same


@pytest.mark.parametrize("most", [None, 0])
def test_repeated_bytes_go(spark, docs, most, monkeypatch):
    if most is not None:
        monkeypatch.setattr(suffix_dedup, "SHARD_CONTEXTS", most)  # all contexts are dealt anew
    docs = docs.union(spark.createDataFrame([(2000, "ab" * 400, None, "", 0), (2001, "z" * 300, None, "", 0), (2002, "abc" * 100 + "lone end", None, "", 0), (None, "q" * 150 + "ab" * 150, None, "", 0)], SCHEMA))
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    count = Counter(t[i : i + 200] for _, t in rows for i in range(len(t) - 199))
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    for key, t in rows:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = 1
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        spans = int((np.diff(np.concatenate(([0], gone))) == 1).sum())
        r = got[key]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    assert suffix_dedup.remove_repeats(empty(docs)).count() == 0


def test_quotations_end_and_clauses_are_scored_alone():
    machine = toxicity.Machine({"moron": 1})
    one = machine.clauses("you are a moron")[0][0]
    for mark in "\"“„«":
        late = machine.clauses(f"5{mark} wide. a. b. c. d. {'word ' * 50}. you are a moron")
        assert late[-1][0] == one  # behind a mark that nothing closes
        assert machine.clauses(f"he {mark}moron{mark} here")[0][1] == [toxicity.REPORTED]
    model = toxicity.Model({"moron": 1}, toxicity.PRIOR)
    mild = model.scores(["he said moron. " * 3, "not a moron. " * 3, "plain words. " * 5000, None, "you are a moron. " + "plain words. " * 5000])
    assert (mild[:4] < 0.5).all() and mild[4] > 0.7


def test_clause_grammar_beats_word_counts():
    """Aimed insults are toxic; negated and reported ones are not. Words alone can't tell them apart."""
    r = random.Random(3)
    bad, good = ("you are a moron", "they are moron", "i will kill you"), ("he said moron", "not a moron", "she wrote: moron", "never kill time")
    plain = lambda: " ".join(r.choices(["stone", "river", "green", "walks", "under"], k=8))
    rows = [(f"{plain()}. {r.choice(bad if i % 2 else good)}. {plain()}.", i % 2) for i in range(400)]
    machine = toxicity.Machine({"moron": 1})
    clauses = [[toxicity.kind_counts(own) for _, own in machine.clauses(t)] for t, _ in rows[:200]]
    model = toxicity.Model({"moron": 1}, toxicity.fit_weights(clauses, np.array([float(y) for _, y in rows[:200]]), np.ones(200)))
    right = sum((s >= 0.7) == bool(y) for s, (_, y) in zip(model.scores([t for t, _ in rows[200:]]), rows[200:], strict=True))
    words = max(sum((("moron" in t or "kill" in t) == bool(y)) for t, y in rows[200:]), sum(not y for _, y in rows[200:]))
    assert right >= 195 > words + 50


def test_toxicity_of_odd_rows(spark):
    rows = [(1, "you idiot", 5.0), (1, "you idiot", 5.0), (2, "you idiot. " * 20_000, 1.0), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    model = toxicity.Model({"idiot": 1}, toxicity.PRIOR)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 4 and [x.predicted for x in got] == [1, 1, 1, 0] and got[0].score == got[1].score <= 1
    assert toxicity.score(docs.filter("false"), model).count() == 0


def test_imatch_columns(docs):
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in imatch.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    prints = defaultdict(set)
    for k, (key, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        r = got[key]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (r.near_next == 1 or after != t)
        prints[t].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert np.mean([got[k].near_edited for k, _ in rows]) > np.mean([got[k].near_next for k, _ in rows])
    assert imatch.fingerprints(empty(docs)).count() == 0
    assert "Python" not in imatch.fingerprints(docs)._jdf.queryExecution().toString()


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_near_duplicates_match_brute_force(docs):
    rows = [(r.doc_id, shingles(r.text)) for r in docs.collect()]
    parent = {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in hyperminhash.near_duplicates(docs).collect()}
    assert got == {k: (len(s), find(k), find(k) == k) for k, s in rows}
    kept = sorted(r.doc_id for r in hyperminhash.keep_one(docs).collect())
    assert kept == sorted(k for k, _ in rows if find(k) == k)
    assert hyperminhash.near_duplicates(empty(docs)).count() == 0


def test_near_duplicates_in_a_hot_group(spark):
    """Variants of one text around the limit: many lie in one family, some outside its largest component."""
    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    test_near_duplicates_match_brute_force(spark.createDataFrame(rows, "doc_id long, text string"))


def test_short_near_copies_inside_many_longer_texts(spark):
    """Two texts that are almost wholly a passage which hundreds of longer texts also hold are one component."""
    r = random.Random(1)
    words = lambda k: [f"w{r.randrange(10**7)}" for _ in range(k)]
    rows = []
    for k in range(4):
        passage = words(12)
        rows += [(1000 * k + i, " ".join([*words(25), *passage, *words(25)])) for i in range(500)]
        rows += [(1000 * k + 900, " ".join(passage)), (1000 * k + 901, " ".join([*passage, "end"]))]
    got = {x.doc_id: x.component_id for x in hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 1000 % 900 if d % 1000 >= 900 else d for d, _ in rows}


def test_every_pair_of_families_in_a_bucket_is_compared():
    r = np.random.default_rng(4)
    draw = lambda k: np.unique(r.integers(0, 2**64, k, dtype=np.uint64))
    passage, rows = draw(200), []
    for k in range(60):
        own = passage if k in (20, 40) else np.unique(np.concatenate((passage, draw(900))))
        rows.append({"nk": bytes([k]), "family": bytes([k if k % 2 or k in (20, 40) else 0]), "main": bytes([0]), "n": len(own), "regs": hyperminhash.sketch(own).tobytes()})
    assert {frozenset(x) for x in hyperminhash.kin_inside(rows, 75)} == {frozenset((bytes([20]), bytes([40])))}


def test_hyperminhash_compares_all_families_of_a_crowded_bucket(spark):
    """A pair that shares this bucket only; with its 1002 members, the bucket has over a million pairs."""
    g = np.random.default_rng(1)
    regs = g.integers(0, 60_000, (1002, hyperminhash.REGISTERS)).astype(np.uint16)
    regs[1] = regs[0]
    regs[1, :: hyperminhash.BAND] += 1
    rows = [(bytes([*k.to_bytes(4, "big")]), k, 500, r.tobytes()) for k, r in enumerate(regs)]
    nodes = spark.createDataFrame(rows, "nk binary, doc_id long, n long, regs binary")
    hits = nodes.select(F.lit(7).cast("long").alias("key"), "nk")
    family = spark.createDataFrame([], "nk binary, family binary")
    got = hyperminhash._between(hits, family, nodes, Tables(spark, "between"), 75).collect()
    assert {frozenset(map(bytes, r)) for r in got} == {frozenset((rows[0][0], rows[1][0]))}


def test_hyperminhash_estimates():
    r = np.random.default_rng(1)
    off = []
    for j in (0.3, 0.75, 0.9):
        shared = int(2000 * j)
        x = np.unique(r.integers(0, 2**64, 2000 - shared + shared, dtype=np.uint64))
        y = np.unique(np.concatenate((x[:shared], r.integers(0, 2**64, len(x) - shared, dtype=np.uint64))))
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        est, _ = hyperminhash.estimate(hyperminhash.sketch(x)[None], hyperminhash.sketch(y)[None], np.array([len(x)]), np.array([len(y)]))
        off.append(abs(est[0] - true))
    assert max(off) < 0.17


@pytest.mark.parametrize("bits", [1, 7, 8, 16, 17, 31, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1003, dtype=np.uint64).astype(np.uint32)
    raw = token_store.pack(ids, bits)
    assert len(raw) == -(-len(ids) * bits // 8)
    for a, b in ((0, 1003), (5, 6), (100, 1003), (7, 7)):
        assert (token_store.unpack(raw, bits, a, b) == ids[a:b]).all()


def test_words_are_parted_from_marks_before_they_are_encoded(monkeypatch):
    """Case and marks make no new words; what the tokenizer treats in another way is left to it."""
    from tokenizers import Tokenizer

    from gleanery.llm.queries import tokenizer_path

    texts = ["", None, "A", "a,", ",", "Foo, foo. FOO! foo?? x?y?", "H\u0331. I\u0307, <|STARTOFTEXT|> <|endoftext|>,", "it's. IT'S, É, é, ÉCOLE. Σ, ΑΣ.", "don't; 12, a1. a,b,", " \n\n x\n", "\t", "K. ﬁ. ẞ! Straße;"]
    enc, t, at, asked = token_store.WordEncoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path()), 0, []
    learn = enc.learn
    monkeypatch.setattr(enc, "learn", lambda words: (asked.extend(words), learn(words)))
    ids, after = enc.encode(pa.array(texts), 2)
    for text, end in zip(texts, after.tolist(), strict=True):
        assert ids[at:end].tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 2], text
        at = end
    assert at == len(ids) and [w for w in asked if w.lower().startswith("foo")] == ["foo", "foo??"]


def test_token_store(spark, docs):
    from tokenizers import Tokenizer

    from gleanery.llm.queries import tokenizer_path

    more = [(2000, "ΣΟΦΟΣ, İstanbul. ǅ! x́, ﬁne. don't 0 10 <|endoftext|> <|startoftext|>! x\x1cy \t z\r\n½ ²,", None, "", 0), (None, "null id", None, "", 0)]
    docs = docs.union(spark.createDataFrame(more, SCHEMA))
    t = Tokenizer.from_file(tokenizer_path())
    blocks = token_store.write_tokens(spark, docs, tokenizer_path(), 49_408, 2)
    got = {r.doc_id: r for r in token_store.read_blocks(blocks).collect()}
    start = 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        x = got[r.doc_id]
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_store.look_up(blocks, 1003)[0].tolist() == [*t.encode("Ab cd", add_special_tokens=False).ids, 2]
    assert token_store.read_blocks(token_store.write_tokens(spark, empty(docs), tokenizer_path(), 49_408, 2)).count() == 0


def test_archives_round_trip(spark):
    rows = [(i, f"http://x.org/{i} ü%", "same" if i % 3 == 0 else f"<p>{i}\r\n\r\nWARC/1.0</p>") for i in range(40)]
    rows += [(100, None, None), (101, "u", ""), (None, "u", "same"), (200, "u", "y" * 3_000_000), (201, "u", "y" * 3_000_000), (39, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    arcs = arc_warc.arc_archives(pages.coalesce(2), archive_bytes=2000)
    heads = {bytes(r.content).split(b"\n")[1][:1] for r in arcs.collect()}
    assert heads == {b"1", b"2"}
    records = arc_warc.read_warc(arc_warc.to_warc(arcs))
    assert {(r.page_id, r.url) for r in records.collect()} == {(p, u) for p, u, _ in rows}
    got = arc_warc.page_records(records).collect()
    top = {}
    for p, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if p is None else p)
    assert len(got) == len(rows)
    for r in got:
        h = next((h or "") for p, _, h in rows if p == r.page_id and arc_warc.base32_sha1((h or "").encode()) == r.payload_digest)
        assert r.payload_bytes == len(h) and r.refers_to == (top[h] if r.record_type == "revisit" else None)
    assert Counter(r.record_type for r in got)["response"] == len(top)
    with pytest.raises(ValueError, match="declares"):
        list(arc_warc.parse_arc(arc_warc.arc_head(1, "a", "2024") + b"\nu 0 2024 t 99\nshort"))
    assert arc_warc.read_warc(arc_warc.to_warc(arc_warc.arc_archives(pages.filter("false")))).count() == 0


@pytest.mark.parametrize("size", [53, 125, 236, 757])
def test_decontamination_recall_at_the_edit_limit(size):
    """Against brute force: the exact distance of every document to every item."""
    r = random.Random(size)
    part = lambda n: " ".join("".join(r.choices(["ta", "re", "mo", "li", "sen", "kor", "ung", "an", "the"], k=r.randint(1, 4))) for _ in range(n))[:n].strip()
    items = [(i, decontaminate.normal(part(size))) for i in range(12)]
    ix = decontaminate.Index(items, 0.1, 0.99, 3.0, 3)
    docs = []
    for _ in range(5):
        for kind in "sidm":
            for _, t in items:
                t = list(t)
                for _ in range(decontaminate.allowed_edits(size, 0.1)):
                    k, p = (kind if kind != "m" else r.choice("sid")), r.randrange(len(t))
                    t[p : p + (k != "i")] = "" if k == "d" else r.choice("xyzqwabe")
                docs.append(decontaminate.normal(f"{part(40)} {''.join(t)} {part(90)}"))
    docs += [part(size) for _ in range(20)]
    want = {(k, i) for k, d in enumerate(docs) for i, t in items if (k >= 240 or i == k % 12) and decontaminate.edit_distance_inside(t, d, allowed := decontaminate.allowed_edits(len(t), 0.1))[0] <= allowed}
    got = {f[:2] for f in ix.search(docs)}
    assert len(want) >= 200 and len(want & got) >= 0.99 * len(want)
    assert all(decontaminate.edit_distance_inside(dict(items)[i], docs[k], 99)[0] <= 0.1 * size for k, i in got)


@pytest.mark.parametrize(("size", "many"), [(53, 300), (125, 300), (236, 300), (757, 60)])
def test_walks_alone_turn_unrelated_windows_away(size, many):
    """Without the pieces: few windows of other texts agree with an item, nearly all windows at the edit limit do."""
    r = random.Random(size)
    words = ["".join(r.choices("eeeeeennnniiirrrssstttaaadddhhuullccggmmoobwfkzvpj", k=r.randint(2, 9))) for _ in range(3000)]
    cut = lambda: " ".join(r.choices(words, k=size))[:size]
    items = [(i, cut()) for i in range(20)]
    ix = decontaminate.Index(items, 0.1, 0.99, 3.0, 3)
    other = [(p, cut(), p % 20) for p in range(many)]
    assert len(ix.near(other)) <= 0.01 * many
    edited = []
    for p in range(60):
        t, kind = list(items[p % 20][1]), "sidm"[p // 20]
        for _ in range(decontaminate.allowed_edits(size, 0.1)):
            k, at = (kind if kind != "m" else r.choice("sid")), r.randrange(len(t))
            t[at : at + (k != "i")] = "" if k == "d" else r.choice("xyzqwabe")
        edited.append((p, f"{''.join(t)} {cut()}"[:size], p % 20))
    assert len(ix.near(edited)) >= 57


def test_decontamination_of_odd_rows(spark):
    item = "an item of the benchmark that is long enough to be found, with some words"
    docs = spark.createDataFrame([(None, f"x {item} y", "a"), (None, "clean text", "b"), (1, "clean text", "c"), (1, item.upper(), "d"), (2, None, "e"), (3, " ", "f"), (4, "say tiny now", "g"), (5, f"{'word ' * 200_000}{item}", "h"), (5, "clean text", "c")], "doc_id long, text string, distance string")
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "  "), (5, "tiny"), (5, "tiny")], "item_id long, text string")
    got = sorted((x.doc_id or 0, x.item_id, x.distance, x.item_chars) for x in decontaminate.find_items(docs, bench).collect())
    n = len(item)
    assert got == [(0, 1, 0, n), (0, 2, 0, n), (1, 1, 0, n), (1, 2, 0, n), (4, 5, 0, 4), (4, 5, 0, 4), (5, 1, 0, n), (5, 2, 0, n)]
    for block in (10, 1 << 20):
        kept = decontaminate.decontaminate(docs, bench, block_chars=block)
        assert kept.columns == docs.columns and sorted(x.distance for x in kept.collect()) == ["b", "c", "c", "e", "f"]


def test_imatch_matches_brute_force(spark, docs):
    """Lexicon, parts, fingerprints and likeness of both texts, recomputed in plain Python from the hash's definition."""
    from math import log

    import regex
    import xxhash

    rows = sorted((r.doc_id, r.text or "") for r in docs.filter("doc_id is not null").collect())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = lambda t: {xxhash.xxh64_intdigest(w.encode(), 42) & ~1 for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w}
    df, n = Counter(h for _, t in rows for h in own(t)), len(rows)
    base = {h for h, k in df.items() if imatch.BAND[0] <= log(n / k) / log(n) <= imatch.BAND[1]}
    assert base

    def part(hashes):
        out = 42
        for h in hashes:
            out = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), out)
        return out & 0x7FFF if hashes else None

    def made(t):
        # Sorted within a class; classes by their first bits.
        found, bits = sorted(own(t) & base), imatch.CLASS_BITS
        if not found:
            return xxhash.xxh64_intdigest(t.encode(), 42)
        parts = [part([h for h in found if h >> 64 - s == c]) for s in range(bits + 1) for c in range(1 << s)]
        return parts + [part([h for h in found if h >> 64 - bits == c and h & (2 << z) - 2 == 0]) for z in range(1, imatch.NARROW + 1) for c in range(1 << bits)]

    def alike(a, b):
        if isinstance(a, int) or isinstance(b, int):
            return float(a == b)
        return sum(x == y for x, y in zip(a, b, strict=True) if x is not None) / sum(x is not None or y is not None for x, y in zip(a, b, strict=True))

    said = lambda p: f"{p:016X}" if isinstance(p, int) else "".join("-" * 4 if x is None else f"{x:04X}" for x in p)
    got = {r.doc_id: r for r in imatch.fingerprints(docs).collect()}
    for k, (key, t) in enumerate(rows):
        other = rows[(k + 1) % n][1]
        half = len(t) // 2
        a, e, x = made(t), made(t[: len(t) - half] + other[:half]), made(other)
        r = got[key]
        assert (r.fingerprint, r.edited_fingerprint) == (said(a), said(e))
        assert r.near_edited == pytest.approx(alike(a, e)) and r.near_next == pytest.approx(alike(a, x))


def test_keep_one_keeps_every_distinct_text(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "a"), (1, long, "a"), (1, "another text with other words in it", "b"), (2, long + " end", "c"), (None, None, "d"), (None, " ", "e"), (3, "one two", "f"), (3, "ONE  two", "g"), (None, "nobody knows the number of this row", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kid string")
    got = hyperminhash.keep_one(docs)
    assert got.columns == docs.columns
    names = sorted(r.kid for r in got.collect())
    assert names in (["a", "b", "d", "e", "f", "h"], ["a", "b", "d", "e", "g", "h"])
    assert hyperminhash.keep_one(docs.filter("false")).count() == 0


def test_decontamination_finds_edited_items(spark):
    r = random.Random(5)
    text = lambda k: " ".join("".join(r.choices("aeioubdklmnrst", k=r.randint(2, 8))) for _ in range(k))
    items = [(i, text(30)) for i in range(20)] + [(90, None), (91, ""), (92, "short")]
    rows, want = [], set()
    for i in range(200):
        t = text(120)
        if i % 4 == 0:
            k = i // 4 % 20
            x = list(items[k][1])
            for _ in range(r.randint(0, int(0.08 * len(x)))):
                x[r.randrange(len(x))] = r.choice("aeioubd")
            t = t[:200].upper() + "\n" + "".join(x) + "  " + t[200:]
            want.add((i, k))
        rows.append((i, t))
    rows += [(900, None), (901, ""), (902, items[0][1]), (903, "the " * 5000)]
    want.add((902, 0))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (100_000, 1500):
        got = {(x.doc_id, x.item_id) for x in decontaminate.find_items(docs, bench, block_chars=block).collect()}
        assert got <= want and len(got) >= 0.99 * len(want)
    assert decontaminate.decontaminate(docs, bench.filter("false")).count() == len(rows)
    assert decontaminate.find_items(docs.filter("false"), bench).count() == 0


def test_edit_distance_is_exact():
    r = random.Random(6)

    def plain(item, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            new = [i]
            for j, d in enumerate(text, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    for _ in range(200):
        a, b = ("".join(r.choices("abc", k=r.randint(1, 12))) for _ in range(2))
        assert decontaminate.edit_distance_inside(a, b, 99)[0] == plain(a, b)


def test_chat_round_trip_and_trees(spark):
    said = "<|im_end|><|im_start|>assistant ok \\ <\\| \n"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (2, 0, None, None), (2, 0, "assistant", "é"), (None, 3, "a\nb<|", "x"), (3, 0, "assistant", ""), (3, 1, "assistant", "日本")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in reply_trees.read_back(reply_trees.chat_conversations(c)).collect()}
    for key in {r[0] for r in rows}:
        mine = sorted([(t, ro or "", tx or "") for k, t, ro, tx in rows if k == key])
        loss = "".join(tx for _, ro, tx in mine if ro == "assistant")
        r = got[key]
        assert r.n_turns == len(mine) and r.turns_sha256 == hashlib.sha256("".join(f"{ro}\n{tx}\n" for _, ro, tx in mine).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert reply_trees.chat_conversations(c.filter("false")).count() == 0
    tree = [("t", 1, None, 0.0), ("t", 2, 1, 1.0), ("t", 3, 1, 5.0), ("t", 4, 2, 9.0), ("t", 5, 3, 0.0), ("t", 6, 5, 0.0), ("u", 1, 2, 0.0), ("u", 2, 1, 0.0), ("v", 7, 99, 1.0)]
    nodes = spark.createDataFrame(tree, "tree string, node long, parent long, score double")
    found = reply_trees.paths(spark, nodes, reply_trees.Tables(spark, "t"))
    paths = defaultdict(list)
    for x in sorted(found.collect(), key=lambda x: -x.up):
        paths[x.tree, x.leaf].append(x.node)
    assert paths == {("t", 4): [1, 2, 4], ("t", 6): [1, 3, 5, 6], ("v", 7): [7]}
    assert [(x.tree, x.leaf) for x in reply_trees.rank_paths(nodes, found).orderBy("tree").collect()] == [("t", 4), ("v", 7)]
    text = reply_trees.chat_conversations(c)._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text
