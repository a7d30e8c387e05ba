"""Abusive, hateful or sexual content: cumulative-link ordinal regression on sparse text features.

Severity grades come from the raters' votes: none, disputed, likely, agreed. One weight vector, shared by all
ordered thresholds, scores a sentence by its words and pairs of words; the grade probabilities are
P(y <= k) = sigmoid(threshold_k - score). A document counts as its worst sentence: training alternates between
fitting the weights and choosing the worst sentence of every document.

There are no word lists. What the labelled sample is too small to show comes from the whole corpus: words that keep company, in
other sentences, with sentences that the model finds bad. Their lift over all documents that have them is the mean of the
weights' prior when the model is fitted again. Every text is brought into its normal form once, in a table; all passes read that.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shared import BLANKS, materialize
from .text import _DROP

#: The labelled sample that the model is fitted on: at most so many documents, chosen by hash, none longer than this.
MAX_LABELLED = 8_000
MAX_CHARS = 50_000
#: Grades of severity: none, disputed, likely, agreed; the expected grade from which a document is reported.
GRADES, REPORT = 4, 0.5
#: Training: precision of the weights' prior, how much more of it a feature gets per share of documents that have it, turns of choosing the worst
#: sentences, steps of the first and of later turns, and the weight of a bad vote where no sentence stands out from clean documents.
PRECISION, COMMON, TURNS, STEPS, MORE, DOUBT = 1.4, 1500.0, 4, 100, 30, 0.05
#: Words in at least this share of all documents are held back in training.
COMMON_SHARE = 0.002
#: Passes over the corpus for the company of words; documents (and share of the documents with bad sentences) that a word needs, documents
#: without company that it is taken to have besides, and the range and weight of the logarithm of its lift.
PASSES, LEAST, LEAST_SHARE, SMOOTH, LIFTS, TRUST = 3, 3, 0.002, 10.0, (0.7, 3.0), 0.7
#: Score of a text without words: severity 0.
NOTHING = -60.0

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
_LOOKALIKES = str.maketrans("аеорсухівкмнтѕјԁɡαεορτυικν", "aeopcyxibkmhtsjdgaeoptuikv")
_SIGNS = str.maketrans("013457@$!|€", "oieastasiie")

_TOKEN = re.compile(r"[^\W_]+(?:['@$!|*#]+[^\W_]+)*|\n|[.?!](?=\s)|[;:,](?=\s)|(?<=\s)[-–](?=\s)|[\"“”«»`„]")
_REPEATED = re.compile(r"(.)\1+")


def _folded(token: str) -> str:
    """A word by its letters: without look-alikes, signs for letters and repeated letters; # for a number; a masked word by its ends."""
    if token in "\n.?!":
        return "\n"
    if token in ";:,-–":
        return ";"
    if token in "\"“”«»`„":
        return '"'
    if "*" in token or "#" in token:
        return f"*{token[0]}{token[-1]}"
    if any(c.isalpha() for c in token):
        token = token.translate(_SIGNS).replace("'", "")
    token = _REPEATED.sub(r"\1", token)
    return "#" if token.isdigit() else token


class _Memo(dict):
    """Folded tokens, looked up; at most 300 000 of them are kept."""

    def __missing__(self, token: str) -> str:
        if len(self) >= 300_000:
            self.clear()
        self[token] = out = _folded(token)
        return out


_memo = _Memo()


def normal_form(text: str) -> str:
    """Folded words of the whole text divided by blanks, its sentences by line ends, clauses by ;. Single letters in a row are one word."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_DROP).translate(_LOOKALIKES).lower().translate(_LOOKALIKES)
    else:
        text = text.lower()
    tokens = list(map(_memo.__getitem__, _TOKEN.findall(text)))
    out, run = [], []
    for t in tokens:
        if len(t) == 1 and t.isalpha():
            run.append(t)
            continue
        if run:
            out.extend(["".join(run)] if len(run) > 2 else run)
            run = []
        out.append(t)
    out.extend(["".join(run)] if len(run) > 2 else run)
    return "\n".join(s for s in (x.strip() for x in " ".join(out).split("\n")) if s)


def _distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, in order."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Model:
    """Weights of words and of pairs of neighbours, and ordered thresholds."""

    def __init__(self, words: dict[str, float], pairs: dict[tuple[str, str], float], thresholds: Sequence[float]) -> None:
        self.words, self.pairs, self.thresholds = words, pairs, [float(t) for t in thresholds]
        names = sorted({*words, *(w for p in pairs for w in p), "\n", ";"})
        self.ids = {w: i + 1 for i, w in enumerate(names)}  # 0: any other word
        self.width = len(names) + 1
        self.single = np.array([0.0] + [words.get(w, 0.0) for w in names])
        keys = {self.ids[a] * self.width + self.ids[b]: v for (a, b), v in pairs.items()}
        self.pair_keys = np.array(sorted(keys), dtype=np.int64)
        self.pair_values = np.array([keys[k] for k in self.pair_keys.tolist()])

    def sentence_scores(self, forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Score of every sentence of the normal forms, in order, and the number of sentences of each.

        A sentence counts as the worse of itself and its clauses; a feature counts once in each.
        """
        sentences, counts = [], np.zeros(len(forms), dtype=np.int64)
        for i, form in enumerate(forms):
            if form:
                part = form.split("\n")
                counts[i] = len(part)
                sentences.extend(part)
        if not sentences:
            return np.zeros(0), counts
        tokens = " \n ".join(sentences).split(" ")
        ids = np.fromiter(map(self.ids.get, tokens, repeat(0)), np.int64, len(tokens))
        ends = ids == self.ids["\n"]
        sentence = np.cumsum(ends)
        clause = np.cumsum(ends | (ids == self.ids[";"]))
        some = np.flatnonzero(self.single[ids] != 0.0)
        both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0)) if len(self.pair_keys) else np.zeros(0, np.int64)
        keys = ids[both] * self.width + ids[both + 1] if len(both) else both
        at = np.minimum(np.searchsorted(self.pair_keys, keys), max(len(self.pair_keys) - 1, 0))
        hit = self.pair_keys[at] == keys if len(both) else np.zeros(0, bool)
        both, at = both[hit], at[hit]

        def totals(owner: np.ndarray) -> np.ndarray:
            n = int(owner[-1]) + 1
            found = _distinct(owner[some] * self.width + ids[some])
            out = np.bincount(found // self.width, self.single[found % self.width], minlength=n)
            if len(both):
                one = np.flatnonzero(owner[both] == owner[both + 1])
                found = _distinct(owner[both[one]] * len(self.pair_keys) + at[one])
                out = out + np.bincount(found // len(self.pair_keys), self.pair_values[found % len(self.pair_keys)], minlength=n)
            return out

        whole, parts = totals(sentence), totals(clause)
        first = np.flatnonzero(np.concatenate([[True], ends[:-1]]))  # where sentences begin
        worst = np.maximum.reduceat(parts, clause[first])
        return np.maximum(whole, worst), counts

    def scores(self, forms: list[str]) -> np.ndarray:
        """Score of the worst sentence of each normal form; one without words scores ``NOTHING``."""
        totals, counts = self.sentence_scores(forms)
        out = np.full(len(forms), NOTHING)
        some = np.flatnonzero(counts)
        if len(some):
            out[some] = np.maximum.reduceat(totals, np.concatenate([[0], np.cumsum(counts[some])[:-1]]))
        return out

    def severity(self, score: np.ndarray) -> np.ndarray:
        """Expected grade, the sum of P(y > k)."""
        return sum(1 / (1 + np.exp(np.clip(t - score, -60, 60))) for t in self.thresholds)


def grade(votes: int, bad: int) -> int:
    """0 none, 1 disputed, 2 likely, 3 agreed by two raters or more."""
    if not bad:
        return 0
    if 2 * bad <= votes:
        return 1
    return 3 if bad >= 2 and bad == votes else 2


def fit_ordinal(
    rows: list[np.ndarray], grades: np.ndarray, weight: np.ndarray, width: int, extra: float | np.ndarray = 0.0, steps: int = 250,
    start: tuple[np.ndarray, np.ndarray] | None = None, prior: np.ndarray | float = 0.0,
) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative-link (logit) regression on sparse binary rows by Adam on the full gradient.

    Weights have a normal prior of mean ``prior`` and precision ``PRECISION``, times 1 + ``extra`` above the mean.
    Thresholds are the first one and the logarithms of the gaps, so they stay ordered.
    """
    index = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), np.array([len(r) for r in rows], dtype=np.int64))
    w, raw = start if start is not None else (np.zeros(width), np.array([1.0, 0.0, 0.0][: GRADES - 1]))
    theta = np.concatenate([w, raw])
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    total = max(weight.sum(), 1e-9)
    y = grades
    for step in range(1, steps + 1):
        w, raw = theta[:width], theta[width:]
        cuts = np.concatenate([[-np.inf], raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))]), [np.inf]])
        eta = np.bincount(owner, w[index], minlength=len(rows))
        up, low = 1 / (1 + np.exp(np.clip(eta - cuts[y + 1], -40, 40))), 1 / (1 + np.exp(np.clip(eta - cuts[y], -40, 40)))
        up[y == GRADES - 1], low[y == 0] = 1.0, 0.0
        p = np.maximum(up - low, 1e-9)
        du, dl = up * (1 - up), low * (1 - low)
        g_eta = weight * (du - dl) / p  # of the negative log likelihood
        g = np.zeros_like(theta)
        pull = np.where(w > prior, 1 + extra, 1.0) * (w - prior) * PRECISION
        g[:width] = (np.bincount(index, g_eta[owner], minlength=width) + pull) / total
        cut_grad = np.zeros(GRADES - 1)
        for k in range(GRADES - 1):
            cut_grad[k] = (-(weight * du / p)[y == k].sum() + (weight * dl / p)[y == k + 1].sum()) / total
        g[width] = cut_grad.sum()
        for k in range(1, GRADES - 1):
            g[width + k] = cut_grad[k:].sum() * np.exp(raw[k])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        theta = theta - 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-9)
    return theta[:width], theta[width:]


class Sample:
    """Labelled texts in normal form, with each text's number of votes and of votes for any bad category; their features are taken once."""

    def __init__(self, forms: Sequence[str], votes: Sequence[int], bad: Sequence[int]) -> None:
        self.ids: dict[str | tuple[str, str], int] = {}
        setdefault, ids = self.ids.setdefault, self.ids
        rows: list[np.ndarray] = []
        document: list[int] = []
        for k, form in enumerate(forms):
            bag = {}
            for s in (form or "").split("\n"):
                t = s.split(" ") if s else []
                clauses = [c.split() for c in s.split(";")] if ";" in t else []
                for part in (t, *filter(None, clauses)):
                    row = _distinct(np.array([setdefault(f, len(ids)) for f in (*part, *zip(part, part[1:]))], dtype=np.int32))
                    bag[row.tobytes()] = row
            rows.extend(bag.values())
            document.extend([k] * len(bag))
        self.row_document = np.array(document, dtype=np.int64)
        self.length = np.array([len(r) for r in rows], dtype=np.int64)
        self.flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        owner = self.row_document[np.repeat(np.arange(len(rows)), self.length)]
        self.in_document = _distinct(owner * max(len(ids), 1) + self.flat)  # (document, feature), once each
        self.grades = np.array([grade(v, b) for v, b in zip(votes, bad)], dtype=np.int64)
        self.confidence = np.sqrt(np.array(votes, dtype=float))

    def train(self, common: dict[str, float] | None = None, lift: dict[str, float] | None = None) -> Model:
        """Fit the model.

        ``common`` has the share of all documents for the words that are frequent in the corpus: what is said everywhere is not what raters
        object to, so positive weights of such features are held closer to zero. ``lift`` has the log-lift of words by their company.
        """
        common, lift, n_ids = common or {}, lift or {}, len(self.ids)
        names: list = [None] * n_ids
        for f, j in self.ids.items():
            names[j] = f
        new = [w for w in lift if w not in self.ids]
        document, feature = self.in_document // max(n_ids, 1), self.in_document % max(n_ids, 1)
        wanted = np.concatenate([np.bincount(feature, minlength=n_ids) >= 2, np.ones(len(new), bool)])
        wanted[[self.ids[w] for w in lift if w in self.ids]] = True
        names = [f for f, w in zip(names + new, wanted) if w]
        kept = np.where(wanted, np.cumsum(wanted) - 1, -1)
        width = len(names)
        if not width or not len(self.grades):
            return Model({}, {}, [1.0, 2.0, 3.0])
        word = np.array([isinstance(f, str) for f in names])
        share = np.array([common.get(f, 0.0) if isinstance(f, str) else min(common.get(f[0], 0.0), common.get(f[1], 0.0)) for f in names])
        prior = np.array([TRUST * lift.get(f, 0.0) if isinstance(f, str) else 0.0 for f in names])
        grades, confidence = self.grades, self.confidence

        # rows with the features that are kept; every sentence and clause of a clean document is clean, and equal ones count together
        flat = kept[self.flat]
        owner = np.repeat(np.arange(len(self.length)), self.length)[flat >= 0]
        flat = flat[flat >= 0]
        length = np.bincount(owner, minlength=len(self.length))
        rows = np.split(flat, np.cumsum(length)[:-1])
        clean: dict[bytes, list] = {}
        for i in np.flatnonzero(grades[self.row_document] == 0).tolist():
            clean.setdefault(rows[i].tobytes(), [rows[i], 0.0])[1] += confidence[self.row_document[i]]

        # the first choice of worst sentences: by how much more bad documents have the feature than clean ones and the corpus
        held, docs = kept[feature], document
        of = lambda some: np.bincount(held[(held >= 0) & some[docs]], confidence[docs[(held >= 0) & some[docs]]], minlength=width)
        with_bad, with_clean = of(grades >= 2), of(grades == 0)
        n_bad, n_clean = max(confidence[grades >= 2].sum(), 1.0), max(confidence[grades == 0].sum(), 1.0)
        usually = 0.5 * (with_clean + 0.5) / n_clean + 0.5 * np.maximum(share, 0.5 / n_clean)
        odds = np.log((with_bad + 0.5) / n_bad / usually)
        guess = np.where(with_bad > 0, odds, np.minimum(odds, 0)) * np.where(word, 1.3, 0.3) + 2 * prior
        state = (guess, np.array([3.0, 0.0, 0.0]))
        first = np.flatnonzero(np.concatenate([[True], self.row_document[1:] != self.row_document[:-1]]))
        of_document = self.row_document[first]
        for turn in range(TURNS):
            value, who = state[0][flat], owner
            if turn == 0:  # the four strongest features of a row
                order = np.lexsort((-value, owner))
                value, who = value[order], owner[order]
                place = np.arange(len(who)) - (np.cumsum(length) - length)[who]
                value, who = value[place < 4], who[place < 4]
            strength = np.bincount(who, value, minlength=len(length))
            worst = np.maximum.reduceat(strength, first)
            usual = np.median(worst[grades[of_document] == 0]) if (grades == 0).any() else -np.inf
            chosen = np.lexsort((-strength, self.row_document))[first]  # the strongest row of every document
            xs, ws = [r for r, _ in clean.values()], [c for _, c in clean.values()]
            ys = [0] * len(xs)
            for k, i, top in zip(of_document.tolist(), chosen.tolist(), worst.tolist()):
                if grades[k]:  # a rater may have erred where nothing in the text stands out from clean documents
                    xs.append(rows[i])
                    ys.append(int(grades[k]))
                    ws.append(confidence[k] * (DOUBT if turn and top <= usual + 1 else 1.0))
            start = state if turn else (prior.copy(), state[1])
            state = fit_ordinal(xs, np.array(ys), np.array(ws), width, COMMON * share, MORE if turn else STEPS, start, prior)
        w, raw = state
        cuts = raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])
        strong = [(names[i], float(w[i])) for i in np.flatnonzero(np.abs(w) > 1e-3).tolist()]
        return Model({f: v for f, v in strong if isinstance(f, str)}, {f: v for f, v in strong if not isinstance(f, str)}, cuts)


def votes_by_document(labels: DataFrame) -> DataFrame:
    """(doc_id, n_votes, n_bad): repeated rows count once, null categories are no vote."""
    named = labels.where(F.col("category").isNotNull() & F.col("doc_id").isNotNull())
    once = named.select("doc_id", "rater", F.lower(F.btrim("category", F.lit(BLANKS))).alias("category")).distinct()
    return once.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_votes"), F.sum((F.col("category") != "none").cast("int")).alias("n_bad")
    )


def normal_forms(documents: DataFrame) -> DataFrame:
    """(doc_id, source, n_chars, form) of every document, in a table: the source by its plain name, the length, and the text's normal form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [normal_form(t) if t else "" for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(forms, pa.string())], names=["doc_id", "source", "n_chars", "form"])

    rows = documents.select(
        "doc_id", F.lower(F.btrim("source", F.lit(BLANKS))).alias("source"), F.length("text").cast("bigint").alias("n_chars"), "text"
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return materialize(rows.mapInArrow(run, f"doc_id {kind}, source string, n_chars bigint, form string"))


def word_documents(forms: DataFrame) -> DataFrame:
    """(word, n_documents) over all documents, counted within batches first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: Counter[str] = Counter()
            for form in batch.column(0).to_pylist():
                count.update(set(form.replace("\n", " ").split(" ")))
            count.pop("", None)
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    return forms.select("form").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n_documents"))


def company(forms: DataFrame, model: Model) -> DataFrame:
    """(word, n_company): documents in which the word stands in a sentence and another sentence is bad; the empty word counts those with any bad one."""
    held = forms.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            scores, counts = m.sentence_scores(texts)
            ends = np.cumsum(counts)
            bad = scores > m.thresholds[0]
            before = np.concatenate([[0], np.cumsum(bad)])
            n_bad = before[ends] - before[ends - counts]
            count: Counter[str] = Counter()
            for i in np.flatnonzero(n_bad).tolist():
                flags = bad[ends[i] - counts[i] : ends[i]]
                others = [s for s, f in zip(texts[i].split("\n"), flags) if n_bad[i] > 1 or not f]
                count.update({w for s in others for w in s.split(" ")})
                count[""] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    return forms.select("form").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n_company"))


def lifts(together: DataFrame, words: DataFrame, n_documents: int) -> dict[str, float]:
    """Log-lift of the words that keep company with bad sentences more than others do.

    A word needs ``LEAST`` such documents and ``LEAST_SHARE`` of all of them, so at most (words per document) / ``LEAST_SHARE`` words come back.
    """
    bad = together.where("word = ''").agg(F.coalesce(F.sum("n_company"), F.lit(0))).first()[0]
    if not bad:
        return {}
    base = bad / n_documents
    share = (F.col("n_company") + SMOOTH * base) / (F.col("n_documents") + SMOOTH)
    rows = (
        together.where((F.col("word") != "") & (F.col("n_company") >= max(LEAST, LEAST_SHARE * bad)))
        .join(words, "word")
        .select("word", F.log(share / base).alias("lift"))
        .where(F.col("lift") > LIFTS[0])
    )
    return {r["word"]: min(r["lift"], LIFTS[1]) for r in rows.collect() if len(r["word"]) > 1 and not r["word"].isdigit()}


def fit(forms: DataFrame, labels: DataFrame) -> Model:
    """Model from a bounded sample: at most ``MAX_LABELLED`` labelled documents of up to ``MAX_CHARS`` characters, by hash.

    ``forms`` are the normal forms of the whole corpus; words are counted, and their company is looked for, over all documents.
    Without labels nothing is known and nothing is reported.
    """
    chosen = (
        forms.where(F.col("n_chars") <= MAX_CHARS)
        .join(votes_by_document(labels), "doc_id")
        .select("doc_id", "form", "n_votes", "n_bad")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(MAX_LABELLED)
    )
    rows = chosen.collect()
    if not rows:
        return Model({}, {}, [1.0, 2.0, 3.0])
    n = forms.count()
    words = materialize(word_documents(forms))
    common = {r["word"]: r["n_documents"] / n for r in words.where(F.col("n_documents") >= max(3, COMMON_SHARE * n)).collect()}
    sample = Sample([r["form"] for r in rows], [r["n_votes"] for r in rows], [r["n_bad"] for r in rows])
    model = sample.train(common)
    for _ in range(PASSES):
        model = sample.train(common, lifts(materialize(company(forms, model)), words, n))
    return model


def score_documents(forms: DataFrame, model: Model) -> DataFrame:
    """(doc_id, source, severity, flagged) for every document; null texts and those without words have severity 0.

    ``severity`` is the expected grade by the ordinal model, and a document is flagged from ``REPORT`` on.
    """
    held = forms.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            severity = m.severity(m.scores(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(severity, pa.float64()), pa.array(severity >= REPORT)],
                names=["doc_id", "source", "severity", "flagged"],
            )

    source = forms.select("doc_id", "source", "form")
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, source string, severity double, flagged boolean")


def rates(scored: DataFrame) -> DataFrame:
    """Per source: documents, flagged ones, their rate and the mean severity."""
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count(F.when(F.col("flagged"), 1)).alias("n_flagged"),
        F.avg(F.col("flagged").cast("double")).alias("flagged_rate"), F.avg("severity").alias("mean_severity"),
    )
