"""Substring dedup of words, hard negatives and periodic runs against brute force; ordinary sentences under the toxicity model."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import hard_negatives, periodic_runs, queries, recompression, toxicity

SF = "/root/testdata/sf0.001"
#: Extra columns have names that the operators use inside.
DOCS = "doc_id long, text string, raw string, kid long, h long, runs int, collapsed string, spans int"


def documents(rows):
    return [(i, t, "x", 1, 2, 3, "y", 4) for i, t in rows]


def words_of(text):
    return (text or "").encode().split()


# --- substring dedup of words ---


def brute_removal(texts, length):
    texts = [words_of(t) for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in texts for i in range(len(w) - length + 1))
    out = []
    for w in texts:
        gone = {j for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def repeating_corpus(seed):
    """Shared passages in different surroundings, copies, repeated words, odd white space, empty and null texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "日本", "a" * 3000]
    text = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passages = [text(r.choice([20, 34, 35, 36, 60, 200])) for _ in range(8)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (None, " ".join(passages[5])), (None, None), (7, "b " * 500), (8, "b " * 40 + "c"), (9, "x y " * 90), (10, "x y " * 40)]
    for i in range(60):
        parts = text(r.choice([0, 3, 40]))
        for _ in range(r.choice([0, 1, 2])):
            parts += r.choice(passages) + text(r.choice([0, 5, 50]))
        rows.append((100 + i, r.choice([" ", "\n", " \t "]).join(parts)))
    rows += [rows[20], rows[20], (rows[21][0], rows[22][1]), (500, rows[30][1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("crowd", [4096, 3])
def test_recompression_equals_brute_force(spark, monkeypatch, seed, crowd):
    monkeypatch.setattr(recompression, "SHARD_CONTEXTS", crowd)  # with 3, whole windows decide
    rows = repeating_corpus(seed)
    got = recompression.remove_repeats(spark.createDataFrame(documents(rows), DOCS), 35).collect()
    want = brute_removal([t for _, t in rows], 35)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))
    assert any(r.n_removed for r in got)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_recompression_of_an_empty_table(spark):
    assert recompression.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_equal_windows_have_one_anchor():
    r = random.Random(5)
    for _ in range(150):
        length, some = r.choice([5, 12, 35]), [b"w%d" % i for i in range(r.choice([1, 2, 3, 50]))]
        shared = [r.choice(some) for _ in range(45)]
        texts = [[r.choice(some) for _ in range(r.randint(0, 40))] + shared[r.randint(0, 20) :] for _ in range(5)]
        found = recompression.contexts(texts, length, False)
        if found is None:
            continue
        by, windows = defaultdict(set), 0
        for d, a, n, h in zip(*found[:4], strict=True):
            for i in range(a, a + n):
                by[tuple(texts[d][i : i + length])].add(int(h))
                windows += 1
        assert windows == sum(max(0, len(t) - length + 1) for t in texts)
        assert all(len(x) == 1 for x in by.values())


def test_windows_with_one_hash_are_told_apart(monkeypatch):
    texts = [b"a b c d", b"e f g h", b"a b c x"]
    expected = [(0, 0, 0), (2, 0, 0)]
    times = np.ones(3, np.int64)
    assert list(zip(*(x.tolist() for x in recompression.repeated_windows(texts, times, 3)), strict=True)) == expected

    class Same(recompression.Spans):
        def hash(self, starts, ends):
            return np.zeros(len(starts), np.uint64)

    monkeypatch.setattr(recompression, "Spans", Same)
    assert list(zip(*(x.tolist() for x in recompression.repeated_windows(texts, times, 3)), strict=True)) == expected


# --- hard negatives ---


def brute_negatives(rows, positives=5, negatives=5):
    """rows: (vec_id, label, vector) with integers, all taking part."""
    width = max((len(v) for _, _, v in rows), default=0)
    m = np.array([list(v) + [0] * (width - len(v)) for _, _, v in rows], dtype=object).reshape(len(rows), width)
    last = 2**63
    out = []
    for a, (i, label, _) in enumerate(rows):
        if i is None or i % 100:
            continue
        s = [int((m[a] * m[b]).sum()) for b in range(len(rows))]
        order = sorted(range(len(rows)), key=lambda b: (-s[b], last if rows[b][0] is None else rows[b][0]))
        for p in [b for b in order if b != a and rows[b][1] == label][:positives]:
            fits = [b for b in order if rows[b][1] != label and 80 * s[p] <= 100 * s[b] <= 100 * s[p]][:negatives]
            out += [(i, rows[p][0], k + 1, rows[b][0], s[p], s[b]) for k, b in enumerate(fits)]
    return Counter(out)


VECTORS = "vec_id long, label int, vector array<long>, row string, cluster string, b int, g int"


def vectors(rows):
    return [(*r, "x", "y", 1, 2) for r in rows]


def mined(spark, rows):
    got = hard_negatives.mine(spark.createDataFrame(vectors(rows), VECTORS), F.col("vec_id") % 100 == 0)
    return Counter(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "PART", 3)
    monkeypatch.setattr(hard_negatives, "GROUP", 8)
    monkeypatch.setattr(hard_negatives, "BLOCK_LEAST", 100)
    monkeypatch.setattr(hard_negatives, "PER_CENTRE", 4)
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 8))
    rows = []
    for i in range(700):
        label = int(r.integers(0, 4))
        v = np.floor(256 * (centres[label] + r.normal(size=8) * 0.6)).astype(int).tolist()
        rows.append((i * 10, label, v))
    same = [int(x) for x in np.floor(256 * centres[0])]
    rows += [(70_000 + i, i % 3, same) for i in range(230)]  # a large group of copies, three labels
    rows += [(80_000, 0, [0] * 8), (80_001, 1, [0] * 8), (80_100, 0, [5]), (80_101, 1, []), (80_200, 9, [1] * 8), (None, 0, same), (None, 1, same)]
    assert mined(spark, rows) == brute_negatives(rows)
    more = [*rows, (5, None, same), (6, 1, None), (7, 1, [1, None])]
    assert mined(spark, more) == brute_negatives(rows)


def test_hard_negatives_of_huge_components(spark):
    rows = [(i * 50, i % 2, [10**9 + i * 7, 3 * i]) for i in range(12)]
    assert mined(spark, rows) == brute_negatives(rows)


def test_hard_negatives_of_an_empty_table(spark):
    assert mined(spark, []) == Counter()


def test_a_repeated_anchor_is_its_copys_positive(spark):
    rows = [(100, 1, [3, 4]), (100, 1, [3, 4]), (2, 2, [3, 4])]
    assert mined(spark, rows) == Counter({(100, 100, 1, 2, 25, 25): 2})


def test_walks_end_before_the_list_does():
    r = np.random.default_rng(1)
    centres = r.normal(size=(20, 16))
    own = r.integers(0, 20, 20_000)
    v = np.floor(256 * (centres[own] + r.normal(size=(20_000, 16)) * 0.1)).astype(np.int64)
    members = v[own == 4][:50]
    c = centres[4] / np.linalg.norm(centres[4])
    shared = hard_negatives.SharedList(v, members, c)
    needed = (members.astype(float) ** 2).sum(axis=1) * 0.7
    walked = sum(len(at) for _, at, _ in shared.walk(needed))
    assert walked < len(v) / 4
    whole = hard_negatives.scores(members, v)
    reached = {int(x) for _, at, _ in shared.walk(needed) for x in at}
    assert {int(x) for x in np.flatnonzero((whole >= needed[:, None]).any(axis=0))} <= reached


# --- periodic runs ---


def brute_runs(words, least=24, exponent=3):
    out = []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(least, exponent * q):
                s = words[i : j + q]
                if not any(s[d:] == s[: n - d] for d in range(1, q)):
                    out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(r):
    out = []
    for _ in range(r.randint(1, 5)):
        some = r.choice([1, 2, 3, 6, 30])
        unit = [b"%d" % r.randrange(some) for _ in range(r.randint(1, 14))]
        out += (unit * r.randint(1, 9))[: r.randint(1, 80)]
    return out[:160]


def test_runs_equal_brute_force():
    r, some = random.Random(1), 0
    for _ in range(600):
        words = periodic_words(r)
        for least, exponent in ((24, 3), (6, 2), (2, 2), (40, 5)):
            want = brute_runs(words, least, exponent)
            assert periodic_runs.word_runs(words, least, exponent) == want
            some += len(want)
    assert some > 500


def test_link_cut_access_tells_the_last_occurrences():
    r = random.Random(2)
    for _ in range(60):
        words = [r.randrange(3) for _ in range(40)]
        links, lengths, prefixes = periodic_runs.automaton(words)
        tree = periodic_runs.LastEnds([max(x, 0) for x in links])
        for i, state in enumerate(prefixes):
            got = {(lengths[x], p) for x, p in tree.access(state, i)}
            want = {}
            for n in range(1, i + 1):  # the last earlier end of the n words that end at i, and the most words for each end
                ends = [e for e in range(n - 1, i) if words[e - n + 1 : e + 1] == words[i - n + 1 : i + 1]]
                if ends:
                    want[ends[-1]] = n
            assert got == {(n, e) for e, n in want.items()}


def expected_digests(doc_id, words):
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    drop = {j for s, n, q in runs for j in range(s + q, s + n)}
    kept = b" ".join(w for j, w in enumerate(words) if j not in drop)
    text = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), best[0], best[1], best[2], milli, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def edited(doc_id, text):
    words = words_of(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_query_equals_brute_force(spark):
    docs = queries.table(spark, SF, "documents").select("doc_id", "text").collect()
    short = [d for d in docs if len(d.text or "") < 20_000]
    got = {r.doc_id: tuple(r[c] for c in _COLUMNS) for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in short:
        assert got[d.doc_id] == expected_digests(d.doc_id, edited(d.doc_id, d.text))
    assert any(v[1] for v in got.values())


def test_runs_of_odd_rows(spark):
    r = random.Random(4)
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a " * 30), (None, None), (4, "a " * 23), (5, "a\t" * 24), (6, "x y z " * 30 + "x"), (6, "x y z " * 30 + "x"), (7, "é 日 " * 5000)]
    rows += [(10 + i, " ".join(w.decode() for w in periodic_words(r))) for i in range(40)]
    df = spark.createDataFrame(documents(rows), DOCS)
    got = periodic_runs.summary(periodic_runs.find_runs(df)).select(_COLUMNS).collect()
    assert Counter(map(tuple, got)) == Counter(expected_digests(i, words_of(t)) for i, t in rows)
    assert periodic_runs.summary(periodic_runs.find_runs(df.filter("false"))).count() == 0


# --- toxicity: ordinary sentences ---

# Ordinary words, many with the first letters of an insult.
ORDINARY = {
    "We saw the {} again this week.": "train morning moment more distance district disk discussion path pathway patient closed close clock cloud clothes school scuba sculpture worth worker track trade tradition "
    "tray transport traffic idea ideal identity loss lost student study stupendous dust dump clover climate image impact import island display dinner moral mortgage market garden window bridge teacher",
    "Heute geht es um {} und den Garten.": "Morgen Distanz Diskussion Pfad Klasse Kloster Wort Worte Transport Tradition Traube Idee Ideal Verlust Student Stufe Staub Klima Bild Insel Moral Moos Markt Fenster Brücke Lehrer "
    "Schule Schrank Scheibe Trasse Trommel Dichter Diesel Disziplin Klang Losung Lose Patent Pause Stuhl Sturm Imker Import Wurst Wolke Würde Müll Mord Disko Dosis",
    "Nous avons parlé de {} hier soir.": "travail train trace tradition morceau morale distance discours dispute disque patience passage clocher clôture climat idée idéal identité perte étude stupeur image impact importance "
    "île jardin fenêtre pont école écran scène science sculpture tracteur trafic transport monde montagne moment mortier losange loisir local poussière poudre wagon world dimension dîner",
    "Ayer hablamos de {} con calma.": "trabajo tren trazo tradición mañana moral distancia discurso disputa disco paciencia pasaje clase claustro clima idea ideal identidad pérdida estudio estupor imagen impacto importe "
    "isla jardín ventana puente escuela escudo escena ciencia escultura tractor tráfico transporte mundo montaña momento mortero losa local polvo vagón dimensión cena mercado maestro patio trama",
}


def test_ordinary_sentences_are_not_toxic(spark):
    sf = "/root/testdata/sf0.1"
    model = toxicity.fit(queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels"))
    sentences = [s.format(w) for s, words in ORDINARY.items() for w in words.split()]
    sentences += ["The train left in the morning.", "They walked more than a short distance on the path.", "A closed school."]
    found = [(s, round(float(x), 2)) for s, x in zip(sentences, model.scores(sentences), strict=True) if x >= 0.3]
    assert len(sentences) > 195 and not found
    assert min(model.scores(["You are a stupid clown.", "He is an idiot."])) >= 0.7
