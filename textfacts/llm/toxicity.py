"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are lower-cased words and their first four, five and six letters.  A bounded sample of labelled documents gives the
examples; all terms of all examples are indexed, and their document frequencies count every document.  The examples
stand in blocks: rare terms as sparse postings, whose products are summed for every example, and terms of many examples
as dense rows with their largest weight in each block.  A block is multiplied only if its maxima and its largest sparse
sum allow a nearer example than the k-th known so far, so the k nearest are exact.

Neighbours vote by closeness, and by how many labelled documents each stands for.  The vote is taken twice: over all
terms, which also gives the evidence, and over the terms whose share of toxic examples is clearly larger (``telling``).
A logistic curve of both, fitted to leave-one-out votes of the sample, turns them into probabilities.  A document is
never its own neighbour.  Ties go to the smaller example id.

Defined results: null and empty texts, texts without any letter, and texts without any term of an example get the
smoothed share of toxic ones among the sample's texts without a telling term, and no evidence.  With labels of one kind
only, or none, the score is that label's (or 0.0).  Repeated rows are scored each; columns other than the named ones are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textfacts.llm.common import has_letter, is_remainder, sample_per_class, slices, table

#: Bounds of the learning sample (documents of each label) and of the telling terms learned from it.
SAMPLE_PER_LABEL = 2000
TERMS = 400
#: How far apart, in standard deviations, the shares of toxic and other documents with a term must be.
MIN_DEVIATION = 5.0
MIN_DOCUMENTS = 3
NEIGHBOURS = 15
BLOCK = 32
_BLOCKS_AT_ONCE = 8
#: A term is dense if more than this share of the examples has it.
_DENSE = 1 / 16
_QUERIES_AT_ONCE = 256
#: Rounding of products of unit vectors with single precision, many times over.
_ROUGHLY = 1e-4
THRESHOLD = 0.3
_WORD = re.compile(r"\w+")


def term_counts(text: str | None, wanted: frozenset[str] | dict[str, int] | None = None) -> Counter:
    """How often each term stands in the whole text; only ``wanted`` terms if given."""
    out = Counter()
    for word, n in Counter(_WORD.findall((text or "").lower())).items():
        for term in {word, "^" + word[:4], "^" + word[:5], "^" + word[:6]}:
            if wanted is None or term in wanted:
                out[term] += n
    return out


_INSIDE = np.zeros(256, bool)
_INSIDE[[b for b in range(128) if _WORD.match(chr(b))]] = True
_INSIDE[0x80:] = True  # until the letter is looked at


def words_of_each(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words (``_WORD``) of all texts end to end, and how many each text has.

    They are cut on the bytes of all texts at once; of letters beyond ASCII each different one is asked for once.
    """
    lowered = [t.lower().encode("utf-8", "replace") if t else b"" for t in texts]
    data = np.frombuffer(b"\n" + b"\n".join(lowered) + b"\n", np.uint8)
    starts = 1 + np.cumsum([0, *(len(t) + 1 for t in lowered)])
    inside = _INSIDE[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        letter = np.zeros(len(lead), np.int64)
        for k in range(4):
            more = k < size
            letter[more] = letter[more] << 8 | data[lead[more] + k]
        different, which = np.unique(letter, return_inverse=True)
        is_word = np.array([bool(_WORD.match(int(x).to_bytes(4).lstrip(b"\0").decode())) for x in different])
        parting = ~is_word[which]
        for k in range(4):
            inside[lead[parting & (k < size)] + k] = False
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # the first and last bytes part texts and are in no word
    first, sizes = edge[0::2], edge[1::2] - edge[0::2]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    words = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside]))
    bounds = np.searchsorted(first, starts)
    return words.cast(pa.string()), np.diff(bounds)


class Numbered:
    """``term_counts`` of many texts by term number: each different word of the texts is looked up once."""

    def __init__(self, terms: dict[str, int]):
        self.terms = len(terms)
        starts = [t for t in terms if t.startswith("^")]  # no word does
        words = [t for t in terms if not t.startswith("^")]
        self._sets = [pa.array(words, pa.string()), pa.array([t[1:] for t in starts], pa.string())]
        self._numbers = [np.array([terms[t] for t in group] + [-1], np.int64) for group in (words, starts)]

    def _of(self, which: int, words: pa.Array) -> np.ndarray:
        """Term numbers, -1 for none."""
        return self._numbers[which][pc.fill_null(pc.index_in(words, value_set=self._sets[which]), -1).to_numpy(zero_copy_only=False)]

    def __call__(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the numbers of its terms, rising, and how often each stands in it."""
        bounds, terms, counts = self.flat(texts)
        return [(terms[a:b], counts[a:b]) for a, b in zip(bounds, bounds[1:])]

    def flat(self, texts: list[str | None]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The same of all texts end to end, and where each text's terms begin (one more entry for the end)."""
        words, of_each = words_of_each(texts)
        coded = words.dictionary_encode()
        distinct = coded.dictionary
        d, width = max(1, len(distinct)), max(1, self.terms)
        own = self._of(0, distinct)
        size = pc.utf8_length(distinct).to_numpy(zero_copy_only=False)
        long = [np.flatnonzero(size >= least) for least in (0, 5, 6)]  # a shorter word is its own first letters once
        cut = [pc.utf8_slice_codeunits(distinct.take(pa.array(of)), 0, letters) for of, letters in zip(long, (4, 5, 6), strict=True)]
        found = self._of(1, pa.concat_arrays(cut))
        begins = np.full((3, len(distinct)), -1, np.int64)
        for k, (of, numbers) in enumerate(zip(long, np.split(found, np.cumsum([len(x) for x in long])[:-1]), strict=True)):
            begins[k, of] = numbers
        row = np.repeat(np.arange(len(texts)), of_each)
        here, n = np.unique(row * d + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        row, word = here // d, here % d
        mine = own[word]
        whole = mine >= 0  # words are different terms; only first letters are shared between words
        some = begins[:, word]
        known = some >= 0
        shared = (row * width + some)[known]
        order = np.argsort(shared)
        shared, times = shared[order], np.broadcast_to(n, some.shape)[known][order]
        first = np.flatnonzero(np.append(True, shared[1:] != shared[:-1])) if len(shared) else np.zeros(0, np.int64)
        keys = np.concatenate([(row * width + mine)[whole], shared[first]])
        counts = np.concatenate([n[whole], np.add.reduceat(times, first) if len(first) else times])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        return np.searchsorted(keys, np.arange(len(texts) + 1) * width).tolist(), keys % width, counts[order].astype(np.int64)


Vector = tuple[np.ndarray, np.ndarray]  # term numbers, and weights with a sum of squares of one


def _pair(v: Vector | dict[int, float]) -> Vector:
    return (np.array(list(v), np.int64), np.array(list(v.values()), float)) if isinstance(v, dict) else v


class BlockMaxIndex:
    """Unit vectors by example, found again by exact cosine.

    Term t's postings are entries ``starts[t]`` to ``starts[t + 1]`` of ``places`` and ``weights``.  A term of many examples has
    none but the row ``row[t]`` of ``dense`` (weights by place) and of ``maxima`` (the largest of each block).
    """

    def __init__(self, vectors: list[Vector | dict[int, float]], ids: list[int], terms: int, block: int = BLOCK):
        vectors = [_pair(v) for v in vectors]
        # examples with the same heaviest terms side by side make blocks whose maxima say much
        heaviest = [t[np.argsort(-w, kind="stable")[:2]].tolist() for t, w in vectors]
        order = sorted(range(len(ids)), key=lambda i: (heaviest[i], ids[i]))
        self.order = order
        size = -(-len(ids) // block) * block
        self.ids = np.full(size, -1, np.int64)
        self.ids[: len(ids)] = [ids[i] for i in order]
        self.block = block
        term = np.concatenate([vectors[i][0] for i in order], dtype=np.int32, casting="same_kind")  # the driver makes this, so it is kept small
        weight = np.concatenate([vectors[i][1] for i in order])
        place = np.repeat(np.arange(len(order), dtype=np.int32), [len(vectors[i][0]) for i in order])
        often = np.flatnonzero(np.bincount(term, minlength=terms) > max(block, len(ids) * _DENSE))
        self.row = np.full(terms, -1, np.int64)
        self.row[often] = np.arange(len(often))
        row = self.row.astype(np.int32)[term]
        self.dense = np.zeros((size, len(often))).T  # an example's weights side by side
        self.dense[row[row >= 0], place[row >= 0]] = weight[row >= 0]
        rare = np.flatnonzero(row < 0)
        rare = rare[np.argsort(term[rare], kind="stable")]
        self.places, self.weights = place[rare].astype(np.int64), weight[rare]
        self.starts = np.searchsorted(term[rare], np.arange(terms + 1, dtype=np.int32))
        del term, weight, place, row, rare
        self._summarise()

    def __getstate__(self) -> dict:
        """Dense rows travel as their entries, which are a tenth of them; what follows from others is made anew."""
        state = {k: v for k, v in self.__dict__.items() if k not in ("dense", "rough", "maxima", "places")}
        row, place = np.nonzero(self.dense)
        return state | {"entries": (row.astype(np.int32), place.astype(np.int32), self.dense[row, place]), "places": self.places.astype(np.int32)}

    def __setstate__(self, state: dict) -> None:
        row, place, weight = state.pop("entries")
        self.__dict__.update(state)
        self.places = self.places.astype(np.int64)
        self.dense = np.zeros((len(self.ids), int((self.row >= 0).sum()))).T
        self.dense[row, place] = weight
        self._summarise()

    def _summarise(self) -> None:
        self.maxima = np.ascontiguousarray(self.dense.T.reshape(len(self.ids) // self.block, self.block, len(self.dense)).max(axis=1).T)
        self.rough = self.dense.astype(np.float32, order="C")  # tells which examples are worth an exact product

    def nearest(self, query: dict[int, float], k: int, without: int | None = None) -> list[tuple[int, float]]:
        """(place, cosine) of the ``k`` nearest examples with a positive cosine, nearest first."""
        return self.nearest_of_each([_pair(query)], k, [without])[0]

    def nearest_of_each(self, queries: list[Vector], k: int, without: list[int | None]) -> list[list[tuple[int, float]]]:
        out = []
        for at in range(0, len(queries), _QUERIES_AT_ONCE):
            out += self._nearest(queries[at : at + _QUERIES_AT_ONCE], k, without[at : at + _QUERIES_AT_ONCE])
        return out

    def _nearest(self, queries: list[Vector], k: int, without: list[int | None]) -> list[list[tuple[int, float]]]:
        size = len(self.ids)
        sums, often = np.zeros((len(queries), size)), np.zeros((len(queries), len(self.dense)))
        for i, (terms, weights) in enumerate(queries):
            row = self.row[terms]
            often[i, row[row >= 0]] = weights[row >= 0]
            rare, w = terms[row < 0], weights[row < 0]
            counts = self.starts[rare + 1] - self.starts[rare]
            entry = np.repeat(self.starts[rare] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            # no entry is out of bounds, so "clip" changes none and spares the check
            products = np.repeat(w, counts)
            products *= self.weights.take(entry, mode="clip")
            sums[i] = np.bincount(self.places.take(entry, mode="clip"), products, minlength=size)
            if without[i] is not None:
                sums[i, self.ids == without[i]] = -2.0  # below zero whatever is added
        # the sparse sums alone say how near the k-th is at least, and with the maxima how near a block's can be at most
        least = np.array([np.partition(s, size - k)[size - k] for s in sums]) if size >= k else np.zeros(len(queries))
        bound = often @ self.maxima + sums.reshape(len(queries), -1, self.block).max(axis=2)
        wanted = (bound > 0) & (bound >= least[:, None] - 1e-9)
        near = sums.astype(np.float32)
        roughly = often.astype(np.float32)
        for b in range(0, wanted.shape[1], _BLOCKS_AT_ONCE):
            some = np.flatnonzero(wanted[:, b : b + _BLOCKS_AT_ONCE].any(axis=1))
            if len(some):
                where = slice(b * self.block, (b + _BLOCKS_AT_ONCE) * self.block)
                near[some, where] += roughly[some] @ self.rough[:, where]
        out = []
        for i, told in enumerate(near):
            kth = np.partition(told, size - k)[size - k] if size >= k else 0.0
            places = np.flatnonzero(told > max(kth - 2 * _ROUGHLY, -1.0))
            terms = np.flatnonzero(often[i])
            exact = sums[i, places] + often[i, terms] @ np.ascontiguousarray(self.dense.T[np.ix_(places, terms)].T)
            places, exact = places[exact > 0], exact[exact > 0]
            best = np.lexsort((self.ids[places], -np.round(exact, 12)))[:k]
            out.append(list(zip(places[best].tolist(), exact[best].tolist(), strict=True)))
        return out


@dataclass
class Votes:
    """Labelled examples that vote for their neighbours."""

    index: BlockMaxIndex
    toxic: np.ndarray  # by place in the index
    stands_for: np.ndarray  # by place: labelled documents for each example
    base: float
    neighbours: int

    def __call__(self, queries: list[Vector], own: list[int | None]) -> tuple[np.ndarray, list[list[tuple[int, float, int]]]]:
        """Log odds of the weighted votes, and the neighbours (example id, cosine, label), for each query."""
        found = self.index.nearest_of_each(queries, self.neighbours, own)
        odds = np.zeros(len(queries))
        for i, near in enumerate(found):
            sums = np.array([1 - self.base, self.base]) * 0.5  # half a vote as the labels are
            for place, cosine in near:
                sums[self.toxic[place]] += self.stands_for[place] * cosine / (1.05 - min(cosine, 1.0)) / 20
            odds[i] = np.log(sums[1] / sums[0])
        return odds, [[(int(self.index.ids[p]), c, int(self.toxic[p])) for p, c in near] for near in found]


def _unit(terms: np.ndarray, weights: np.ndarray) -> Vector:
    return terms, weights / (np.sqrt((weights**2).sum()) or 1.0)


@dataclass
class Model:
    terms: dict[str, int]  # the telling ones
    base: float
    empty: float  # score of texts that no example has a term of
    vocabulary: dict[str, int] = field(default_factory=dict, repr=False)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))  # inverse document frequencies, by vocabulary
    telling: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # by vocabulary: number in ``terms`` or -1
    whole: Votes | None = None
    told: Votes | None = None
    curve: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def vectors(self, terms: np.ndarray, counts: np.ndarray) -> tuple[Vector, Vector]:
        """The unit vectors over all terms and over the telling ones."""
        w = (1 + np.log(counts)) * self.weights[terms]
        told = self.telling[terms]
        return _unit(terms, w), _unit(told[told >= 0], w[told >= 0])

    def features(self, pairs: list[tuple[Vector, Vector]], own: list[int | None]) -> tuple[np.ndarray, list[list[tuple[int, float, int]]]]:
        """Log odds of both votes and a one, and the neighbours over all terms, for each text."""
        x = np.ones((len(pairs), 3))
        x[:, 0], near = self.whole([v for v, _ in pairs], own)
        x[:, 1] = np.log(self.empty / (1 - self.empty))
        some = [i for i, (_, v) in enumerate(pairs) if len(v[0])]
        if some and self.told is not None:
            x[some, 1] = self.told([pairs[i][1] for i in some], [own[i] for i in some])[0]
        return x, near

    def score(self, texts: list[str | None], own: list[int | None], numbered: Numbered) -> list[tuple[float, list[tuple[int, float, int]]]]:
        out, some, pairs = [(self.empty, [])] * len(texts), [], []
        found = numbered([t if has_letter(t) else None for t in texts]) if self.whole else []
        for i, (terms, counts) in enumerate(found):
            if len(terms):
                some.append(i)
                pairs.append(self.vectors(terms, counts))
        if some:
            x, near = self.features(pairs, [own[i] for i in some])
            for i, p, e in zip(some, 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30))), near, strict=True):
                out[i] = (float(p), e)
        return out


def _logistic_curve(design: np.ndarray, y: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Slopes (at least 0.05) and offset that maximise the weighted likelihood, by Newton's steps with a small pull to slopes of 1 in sum."""
    prior, pull = np.array([*[1 / (design.shape[1] - 1)] * (design.shape[1] - 1), 0.0]), 0.02
    w = prior
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (share * (p - y)) + pull * (w - prior)
        bend = (design * (share * p * (1 - p))[:, None]).T @ design + pull * np.eye(len(w))
        w = w - np.linalg.solve(bend, slope)
    return np.array([*np.maximum(0.05, w[:-1]), w[-1]])


def choose_terms(sample: DataFrame, limit: int = TERMS) -> tuple[dict[str, int], dict[str, int]]:
    """The terms whose shares of toxic and other documents of ``sample`` (text, toxic) differ most, the toxic share larger; and all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=16 << 20):
            seen = (Counter(), Counter())
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                seen[toxic].update(term_counts(text).keys())
            terms = list(seen[0] | seen[1])
            if terms:
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([seen[0][t] for t in terms], pa.int64()), pa.array([seen[1][t] for t in terms], pa.int64())], ["term", "other", "toxic"])

    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = max(1, totals.get(0, 0)), max(1, totals.get(1, 0))
    both = sample.mapInArrow(run, "term string, other long, toxic long").groupBy("term").agg(F.sum("other").alias("a"), F.sum("toxic").alias("b")).toArrow()
    a, b = (both.column(c).to_numpy().astype(float) for c in ("a", "b"))
    share = (a + b) / (n0 + n1)
    z = (b / n1 - a / n0) / np.sqrt(share * (1 - share) * (1 / n0 + 1 / n1) + 1e-12)
    names = both.column("term").to_pylist()
    best = sorted(np.flatnonzero((b >= MIN_DOCUMENTS) & (z >= MIN_DEVIATION)).tolist(), key=lambda i: (-z[i], names[i]))[:limit]
    number = lambda terms: {t: i for i, t in enumerate(sorted(terms))}
    return number(names[i] for i in best), number(names)


def document_frequencies(docs: DataFrame, terms: dict[str, int]) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each term, over the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen, numbered = 0, np.zeros(len(terms), np.int64), Numbered(terms)
        for part in slices(batches):
            count += part.num_rows
            seen += np.bincount(numbered.flat(part.column("text").to_pylist())[1], minlength=len(terms))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some], pa.int32()), pa.array([count, *seen[some]], pa.int64())], ["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    got = np.zeros(len(terms) + 1)
    got[rows.column("term").to_numpy()] = rows.column("n").to_numpy()  # the last one is -1
    return int(got[-1]), got[:-1]


def learn(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, limit: int = TERMS, neighbours: int = NEIGHBOURS) -> Model:
    """Fit on at most ``per_label`` documents of each value of ``labels.toxic`` (doc_id, toxic); term statistics from all ``docs``."""
    rows = labels.select("doc_id", "toxic").where("toxic in (0, 1)")
    shares = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    known = sum(shares.values())
    base = shares.get(1, 0) / known if known else 0.0
    if len(shares) < 2:
        return Model({}, base, base)
    chosen = sample_per_class(rows, "toxic", per_label)
    # at most two times per_label narrow rows, so they may be sent to every task
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    terms, vocabulary = choose_terms(sample, limit)
    count, seen = document_frequencies(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            counts = [term_counts(t, vocabulary) if has_letter(t) else {} for t in part.column("text").to_pylist()]
            columns = [part.column("doc_id"), part.column("toxic"), pa.array([[vocabulary[t] for t in c] for c in counts], pa.list_(pa.int32())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "toxic", "term", "n"])

    got = sample.mapInArrow(run, "doc_id long, toxic int, term array<int>, n array<int>").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    ids, labels_of = got.column("doc_id").to_numpy(), got.column("toxic").to_numpy()
    one = np.flatnonzero(np.append(ids[1:] != ids[:-1], True)) if len(ids) else np.zeros(0, int)  # one example for each id
    drawn = Counter(labels_of[one].tolist())
    model = Model(terms, base, base, vocabulary, np.log((count + 1) / (seen + 1)) + 1, np.array([terms.get(t, -1) for t in vocabulary], np.int64))
    pairs = [model.vectors(*(got.column(c)[int(i)].values.to_numpy().astype(kind) for c, kind in (("term", np.int64), ("n", float)))) for i in one]
    ids, labels_of = ids[one], labels_of[one]
    del got
    for_each = {y: shares[y] / drawn[y] for y in drawn}
    scale = min(for_each.values(), default=1.0)

    def votes(which: int) -> Votes | None:
        full = [i for i, p in enumerate(pairs) if len(p[which][0])]
        if not full:
            return None
        index = BlockMaxIndex([pairs[i][which] for i in full], ids[full].tolist(), len((vocabulary, terms)[which]))
        toxic = labels_of[[full[i] for i in index.order]]
        return Votes(index, toxic, np.array([for_each[y] / scale for y in toxic.tolist()]), base, neighbours)

    bare = Counter(y for y, p in zip(labels_of.tolist(), pairs, strict=True) if not len(p[1][0]))
    toxic, other = bare[1] * for_each.get(1, 1), bare[0] * for_each.get(0, 1)
    model.empty = (toxic + base) / (toxic + other + 1)
    model.whole, model.told = votes(0), votes(1)
    if model.whole:
        full = [i for i, p in enumerate(pairs) if len(p[0][0])]
        x, _ = model.features([pairs[i] for i in full], ids[full].tolist())
        model.curve = _logistic_curve(x, labels_of[full], np.array([for_each[y] / scale for y in labels_of[full].tolist()]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, evidence): the evidence is the nearest examples' ids, cosines and labels."""
    near = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        numbered = Numbered(fitted.vocabulary)
        for part in slices(batches):
            ids = part.column("doc_id")
            got = fitted.score(part.column("text").to_pylist(), ids.to_pylist(), numbered)
            value = np.array([s for s, _ in got])
            evidence = pa.array([[{"doc_id": d, "cosine": c, "toxic": y} for d, c, y in e[:5]] for _, e in got], near)
            yield pa.RecordBatch.from_arrays([ids, pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32)), evidence], ["doc_id", "score", "predicted", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, evidence array<struct<doc_id: long, cosine: double, toxic: int>>")


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").where(F.col("doc_id").isNotNull() & ~is_remainder(F.col("doc_id"), 4, 2))
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", is_remainder(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted", "evidence")
