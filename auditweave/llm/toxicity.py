"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine.

The kernel compares words by their common subsequences of three letters, each weighted by ``DECAY`` to the length it spans,
so a letter inserted into an insult or a gap between its letters only lowers the weight. The machine is trained on labelled
sentences as bags of words: a sentence is as toxic as its most toxic word, so each toxic sentence stands for its word with
the largest margin (its witness) and every word of the clean sentences is a negative example. Witnesses start as the words
with the largest share of toxic sentences and are chosen anew after each training until they stay. Landmarks are witnesses
and clean words; the kernel against them, whitened (Nystroem), is the space of a linear support vector machine, and a
logistic curve over a text's largest margin gives the text's score. The machine is linear in kernel values, so for scoring
it is expanded once into a table over letter triples: the same function, at the cost of a look-up for each triple of a word.

Words are lower-cased, bare of outer punctuation; letters standing alone in a row (``i d i o t``) are joined; longer words
are read in windows of ``LONGEST`` letters, half a window apart, so that every stretch of half a window and one letter lies
in one (wider gaps weigh under 2 % in the kernel). The fit uses the texts of a bounded sample of labelled rows
(``labelled.MAX_ROWS``) outside the held-out fold, with all their words; scoring covers every word of every row. Edge cases:
null and empty texts have no words and get the score of a text with neutral words only; a text of any length is one bag;
ties between words go by their place in the sorted vocabulary; repeated rows get equal scores; an empty table gives an empty
table; extra columns are ignored; without labelled rows of both kinds every score is the share of toxic labels.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.llm.arrowio import bounded_batches, id_text, map_texts
from auditweave.llm.labelled import MAX_ROWS, labelled_sample, remainder

ORDER, DECAY, LONGEST = 3, 0.7, 20
TOXIC_LANDMARKS, CLEAN_LANDMARKS, CLEAN_WORDS, HARD_WORDS, ROUNDS, RIDGE, STEPS = 160, 64, 3000, 3000, 4, 1e-5, 800
#: A witness weighs as the square root of its sentences, so that frequent insults don't drown rare ones.
FOLDS, HELD, ACCEPT = 3, 1, 0.7
CLASSES, OUTER = 96, ".,;:!?\"'()[]{}<>*#$%&|-_~`…«»„“”’"
#: Words remembered by one Python worker; beyond, the memory starts anew, results stay the same.
WORD_CACHE = 800_000
#: Letter triples of the sample's words that the fit holds, as 32-bit numbers.
HELD_TRIPLES = 30_000_000
#: Sum of kernel values is bounded by this many letter triples at a time.
CHUNK = 500_000


def letter_classes(words: list[str], n: int) -> np.ndarray:
    """Rows of n numbers for words of n letters. Letters and digits of Latin scripts have classes of their own as far as there is room; the rest share by number."""
    c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64).reshape(len(words), n)
    latin = (c >= 224) & (c < 256)
    return np.select([(c >= 97) & (c <= 122), (c >= 48) & (c <= 57), latin], [c - 97, 26 + c - 48, 36 + c - 224], 68 + c % (CLASSES - 68))


@lru_cache(maxsize=None)
def triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.array(list(combinations(range(n), ORDER)), np.int64).reshape(-1, ORDER)
    return at, (DECAY ** (at[:, -1] - at[:, 0] + 1)).astype(np.float64)


def features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triple numbers of words of one length (rows), and the weights of their columns."""
    at, weight = triples(codes.shape[1])
    return (codes[:, at[:, 0]] * CLASSES + codes[:, at[:, 1]]) * CLASSES + codes[:, at[:, 2]], weight


def norms(f: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Square root of the kernel of each word with itself: equal triples of a word add up before they are squared."""
    if not f.shape[1]:
        return np.ones(len(f))
    order = np.argsort(f, axis=1)
    f, w = np.take_along_axis(f, order, 1), weight[order]
    first = np.ones(f.shape, bool)
    first[:, 1:] = f[:, 1:] != f[:, :-1]
    sums = np.add.reduceat(w.ravel(), np.flatnonzero(first.ravel()))
    owner = np.repeat(np.arange(len(f)), first.sum(1))
    return np.sqrt(np.bincount(owner, sums * sums, len(f)))


def by_length(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each word length: the places in the list and the letter classes, in bounded pieces."""
    places: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        places.setdefault(len(w), []).append(k)
    out = []
    for n, at in places.items():
        size = max(1, CHUNK // max(1, math.comb(n, ORDER)))
        for i in range(0, len(at), size):
            part = at[i : i + size]
            out.append((np.array(part), letter_classes([words[k] for k in part], n)))
    return out


def expand(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Table over triples of the weighted sum of the words' normalised feature vectors."""
    table = np.zeros(CLASSES**ORDER)
    for at, codes in by_length(words):
        f, w = features(codes)
        np.add.at(table, f, weights[at][:, None] * w[None, :] / norms(f, w)[:, None])
    return table


def prepared(words: list[str], most: int = HELD_TRIPLES) -> list[tuple]:
    """Places, triple numbers, column weights and norms of words, piece by piece, for repeated use. Pieces beyond ``most`` triples stay letter classes and are worked out at each use."""
    out = []
    for at, codes in by_length(words):
        if (most := most - len(at) * math.comb(codes.shape[1], ORDER)) < 0:
            out.append((at, codes, None, None))
        else:
            f, w = features(codes)
            out.append((at, f.astype(np.int32), w, norms(f, w)))
    return out


def against(table: np.ndarray, words: list[str], ready: list[tuple] | None = None) -> np.ndarray:
    """Normalised kernel sums of words with what the table expands; ready: what ``prepared`` gave for them."""
    out = np.zeros(len(words))
    for at, f, w, n in prepared(words, 0) if ready is None else ready:
        if w is None:
            f, w = features(f)
            n = norms(f, w)
        out[at] = (table[f] * w).sum(1) / n
    return out


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of words with landmarks; only the landmarks' own triples are looked at."""
    rows = [(at, f, w / norms(f, w)[:, None]) for at, codes in by_length(landmarks) for f, w in [features(codes)]]
    own = np.unique(np.concatenate([f.ravel() for _, f, _ in rows])) if rows else np.zeros(0, np.int64)
    place, table = np.full(CLASSES**ORDER, len(own)), np.zeros((len(own) + 1, len(landmarks)))
    place[own] = np.arange(len(own))
    for at, f, w in rows:
        np.add.at(table, (place[f], at[:, None]), w)
    out = np.zeros((len(words), len(landmarks)))
    for at, codes in by_length(words):
        for i in range(0, len(at), 256):
            f, w = features(codes[i : i + 256])
            n = norms(f, w)
            for k in range(f.shape[1]):
                out[at[i : i + 256]] += table[place[f[:, k]]] * (w[k] / n)[:, None]
    return out


def units(token: str) -> list[str]:
    t = token.strip(OUTER)
    if not t.isalpha() and len(bare := "".join(filter(str.isalpha, t))) >= ORDER:
        t = bare
    if len(t) <= LONGEST:
        return [t] if len(t) >= ORDER else []
    return [t[i : i + LONGEST] for i in range(0, len(t) - LONGEST // 2, LONGEST // 2)]


def tokens(text: str) -> set[str]:
    """Distinct tokens, with rows of single letters joined."""
    got = text.lower().split()
    out, run = set(got), []
    if len(got) > 3:
        for i in [i for i, t in enumerate(got) if len(t) == 1 or (len(t) == 2 and t[1] in OUTER)]:
            if run and run[-1] != i - 1:
                if len(run) > 3:
                    out.add("".join(got[j][0] for j in run))
                run = []
            run.append(i)
        if len(run) > 3:
            out.add("".join(got[j][0] for j in run))
    return out


class ToxicityModel:
    def __init__(self, table: np.ndarray, bias: float, curve: tuple[float, float]) -> None:
        self.table, self.bias, self.curve = table.astype(np.float32), bias, curve

    def margins(self, toks: list[str]) -> np.ndarray:
        """Largest margin among the units of each token; -1 where a token has none."""
        parts = [units(t) for t in toks]
        flat = [u for p in parts for u in p]
        m = np.clip(against(self.table, flat) + self.bias, -1.0, 1.0) if flat else np.zeros(0)
        out, owner = np.full(len(toks), -1.0), np.repeat(np.arange(len(toks)), [len(p) for p in parts])
        np.maximum.at(out, owner, m)
        return out

    def scorer(self):
        memory: dict[str, float] = {}

        def score(texts: list[str]) -> list[float]:
            words = [tokens(t) for t in texts]
            new = list({w for ws in words for w in ws if w not in memory})
            if len(memory) + len(new) > WORD_CACHE:
                memory.clear()
                new = list({w for ws in words for w in ws})
            memory.update(zip(new, self.margins(new).tolist(), strict=True))
            return curve_of(self.curve, [max((memory[w] for w in ws), default=-1.0) for ws in words]).tolist()

        return score


def curve_of(curve: tuple[float, float], tops: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] + curve[1] * np.asarray(tops, float), -60, 60)))


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared hinge with an L2 penalty, by accelerated gradient; y is -1 or 1."""
    a = np.column_stack([x, np.ones(len(x))])
    weight = weight / weight.sum()
    step = 1 / (2 * float(np.linalg.eigvalsh(a.T @ (a * weight[:, None]))[-1]) + RIDGE)
    w = ahead = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(STEPS):
        lack = np.maximum(1 - y * (a @ ahead), 0)
        grad = -2 * a.T @ (weight * y * lack)
        grad[:-1] += RIDGE * ahead[:-1]
        v = ahead - step * grad
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = v + (before - 1) / t * (v - w), v
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        ridge = np.diag([0.0] + [0.5] * x.shape[1])
        w = w - np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge + 1e-6 * np.eye(len(w)), a.T @ (p - y) + ridge @ w)
    return tuple(w.tolist())


def whitening(landmarks: list[str]) -> np.ndarray:
    """Nystroem: kernel rows against the landmarks times this are points whose inner products are the kernel, exactly so on the landmarks."""
    own, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    free = own > 1e-6 * own[-1]
    return vectors[:, free] / np.sqrt(own[free])


def best_of(bags: np.ndarray, ids: np.ndarray, values: np.ndarray, n_bags: int) -> np.ndarray:
    """For each bag the id with the largest value, the smallest of equals; -1 for an empty bag."""
    out = np.full(n_bags, -1)
    order = np.lexsort((-ids, values[ids], bags))
    out[bags[order]] = ids[order]  # the last one of a bag stays
    return out


def fit(vocabulary: list[str], ids: np.ndarray, sizes: np.ndarray, marks: np.ndarray) -> ToxicityModel:
    """ids: places in the sorted vocabulary of the distinct units of one text of the sample after the other; sizes: how many each text has; marks: 1 for toxic texts."""
    share = (marks.sum() + 0.5) / (len(marks) + 1) if len(marks) else 0.5
    flat = ToxicityModel(np.zeros(CLASSES**ORDER), -1.0, (math.log(share / (1 - share)), 0.0))
    bags = np.repeat(np.arange(len(marks)), sizes)
    toxic = marks[bags] == 1
    hits, often = (np.bincount(ids[toxic == t], minlength=len(vocabulary)) for t in (True, False))
    if not hits.any() or not often.any():
        return flat
    name = np.array(vocabulary, object)
    values = np.log((hits + 0.5) / (marks.sum() + 1)) - np.log((often + 0.5) / (len(marks) - marks.sum() + 1))
    calm, ready = np.flatnonzero(often), prepared(vocabulary)
    spread = calm[np.lexsort((calm, -often[calm]))]
    spread = spread[:: max(1, len(spread) // CLEAN_WORDS)][:CLEAN_WORDS]
    negative, witness, white, landmarks, have = np.sort(spread), None, None, [], np.zeros((0, 0))
    for _ in range(ROUNDS):
        before, witness = witness, best_of(bags[toxic], ids[toxic], values, len(marks))
        if before is not None and (before == witness).all():
            break
        positive, sentences = np.unique(witness[witness >= 0], return_counts=True)
        if white is None:
            first = positive[np.lexsort((positive, -sentences))][:TOXIC_LANDMARKS]
            landmarks = name[[*first, *spread[:: max(1, len(spread) // CLEAN_LANDMARKS)][:CLEAN_LANDMARKS]]].tolist()
            white = whitening(landmarks)
            have = kernel(name[negative].tolist(), landmarks) @ white
        points = kernel(name[positive].tolist(), landmarks) @ white
        for mined in (False, True):
            x = np.concatenate([points, have])
            y = np.repeat([1.0, -1.0], [len(positive), len(negative)])
            weights = np.sqrt(sentences), np.sqrt(np.maximum(often[negative], 1))
            w, bias = svm(x, y, np.concatenate([v / v.sum() for v in weights]))
            table = expand(landmarks, white @ w)
            values = against(table, vocabulary, ready) + bias
            if not mined:  # words of clean sentences that look toxic join the negatives
                hard = calm[np.lexsort((calm, -values[calm]))][:HARD_WORDS]
                new = np.setdiff1d(hard[values[hard] > -0.7], negative)
                negative, have = np.concatenate([negative, new]), np.concatenate([have, kernel(name[new].tolist(), landmarks) @ white])
    model = ToxicityModel(table, bias, (0.0, 0.0))
    tops = np.full(len(marks), -1.0)
    np.maximum.at(tops, bags, np.clip(values, -1.0, 1.0)[ids])
    model.curve = logistic(tops[:, None], marks.astype(float))
    return model


def learned(docs: DataFrame, labels: DataFrame, folds: int | None = FOLDS, held: int | None = HELD, max_rows: int = MAX_ROWS) -> ToxicityModel:
    def run(batches):
        for b in batches:
            got = [sorted({u for t in tokens(x) for u in units(t)}) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(got, pa.list_(pa.string()))], ["doc_id", "label", "units"])

    sample = bounded_batches(labelled_sample(docs, labels, "toxic", folds, held, max_rows)).mapInArrow(run, "doc_id long, label int, units array<string>")
    rows = sample.groupBy("doc_id").agg(F.min(F.struct("label", "units")).alias("s")).select("doc_id", "s.*").toArrow().sort_by("doc_id").combine_chunks()
    if not rows.num_rows:
        return fit([], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    units_of = rows.column("units").combine_chunks()
    words = pc.dictionary_encode(units_of.flatten())
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    place = pc.rank(words.dictionary, sort_keys="ascending", tiebreaker="first").to_numpy().astype(np.int64) - 1  # in order of the words, however rows came
    vocabulary = words.dictionary.take(pa.array(np.argsort(place))).to_pylist()
    return fit(vocabulary, place[words.indices.to_numpy()], pc.list_value_length(units_of).to_numpy().astype(np.int64), rows.column("label").to_numpy().astype(np.int64))


def toxicity_scores(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. train_docs: where the labelled texts are, by default docs."""
    model = learned(docs if train_docs is None else train_docs, labels, max_rows=max_rows)

    def make():
        score = model.scorer()

        def work(texts):
            return [[s for i in range(0, len(texts), 100) for s in score(texts[i : i + 100])]]

        return work

    rows = map_texts(id_text(docs, id_col, text_col), make, "score double", ["score"], [pa.float64()])
    return rows.select("doc_id", (F.coalesce(remainder(F.col("doc_id"), FOLDS), F.lit(0)) == HELD).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
