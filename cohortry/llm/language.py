"""Language of texts and of their spans: script ranges, per-word scores, Viterbi with a switching penalty."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import ROWS_AT_ONCE, batch_of, kept_tables, map_batches, text_or_empty

SAMPLE_PER_LANGUAGE = 4000   # labelled rows, whole, that a language is learned from; expected number where it has more
CELLS_AT_ONCE = 500_000      # letters times languages that are scored together
GRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 16            # hashed letter sequences; bounds the model
SMOOTHING = 0.5
SWITCH = 12.0                # natural-log units that a change of language costs
SCRIPT_SHARE = 0.005         # a language has a script if so many of its letters are in it
NO_FIT, FULL_FIT = 0.81, 0.93  # where a text lies from chance (0) to its language's own text (1): not known at all, known
FIT_LETTERS = 20             # letters of full fit that every text is given, as a few letters prove nothing
LEARNED_LETTERS = 2000       # a language learned from so many letters asks for half the fit
CACHED_WORDS = 150_000
CACHED_LENGTH = 48
UNKNOWN = "und"

# First code points of script ranges; a range lasts until the next one starts.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Other"),
    (0x0B80, "Tamil"), (0x0C00, "Other"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3130, "Hangul"),
    (0x3190, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"),
    (0xFB00, "Latin"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFF21, "Latin"), (0xFF65, "Kana"), (0xFFA0, "Other"),
    (0x20000, "Han"), (0x323B0, "Other"),
)
_STARTS = np.array([start for start, _ in SCRIPTS])
SCRIPT_NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))
_SCRIPT = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])
_LETTERS: list[np.ndarray] = []
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _is_letter() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points with 0 for what is no letter, word starts, word ends); each word is lower-cased and has a 0 on both sides."""
    lowered = [w.lower() for w in words]
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 2
    code = np.frombuffer(("\n" + "\n\n".join(lowered) + "\n").encode("utf-32-le"), np.uint32)
    ends = np.cumsum(lengths)
    return np.where(_is_letter()[code], code, 0), ends - lengths, ends


def gram_buckets(code: np.ndarray):
    """For each sequence length: (bucket of the sequence that starts here, whether it stays in one run of letters).

    Sequences of two or more may take in one end of a run as its mark.
    """
    inside = code != 0
    wide = code.astype(np.uint64) + np.uint64(1)
    for n in GRAMS:
        if n == 1:
            mixed, valid = wide * _MIX[0], inside
        else:
            size = max(0, len(code) - n + 1)
            mixed = np.zeros(size, np.uint64)
            for k in range(n):
                mixed = (mixed ^ wide[k:k + size]) * _MIX[k]
                mixed ^= mixed >> np.uint64(29)
            valid = np.ones(size, bool)
            for k in range(1, n - 1):
                valid &= inside[k:k + size]
            valid &= inside[:size] | inside[n - 1:n - 1 + size]
        mixed = (mixed ^ np.uint64(n)) * _MIX[1]
        yield (mixed >> np.uint64(40)) % np.uint64(BUCKETS), valid


class Model:
    """Learned languages, their log-odds for each bucket against a background of equal odds, and their scripts.

    ``chance`` and ``own`` are the log-odds a letter that a language gives to
    sequences of the background and to its own text; ``learned`` counts the
    letters it was learned from.
    """

    def __init__(self, languages: list[str], weights: np.ndarray, scripts: np.ndarray,
                 chance: np.ndarray, own: np.ndarray, learned: np.ndarray) -> None:
        self.languages, self.weights, self.scripts = languages, weights, scripts
        self.chance, self.own, self.learned = chance, own, learned

    def fit(self, language: int, odds: float, letters: float) -> float:
        """0 to 1: how far log-odds of so many letters are the language's own and not those of other signs."""
        width = max(1e-9, self.own[language] - self.chance[language])
        at = ((odds - letters * self.chance[language]) / width + FIT_LETTERS) / (letters + FIT_LETTERS)
        asked = self.learned[language] / (self.learned[language] + LEARNED_LETTERS)
        return float(min(1.0, max(0.0, (at - asked * NO_FIT) / (FULL_FIT - NO_FIT))))

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score of each language, letters, log-odds of the best one) of each word.

        Scores are against the best one; languages without the word's script
        fall far back. Log-odds are nan if no language has the script.
        """
        at, parts, size = 0, [], 0
        for i, word in enumerate(words):
            size += (len(word) + 2) * len(self.languages)
            if size > CELLS_AT_ONCE:
                parts.append(self._scores(words[at:i + 1]))
                at, size = i + 1, 0
        if at < len(words):
            parts.append(self._scores(words[at:]))
        return tuple(np.concatenate(p) for p in zip(*parts))

    def _scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code, starts, ends = letters_of(words)
        values = np.zeros((len(code), len(self.languages)))
        for bucket, valid in gram_buckets(code):
            at = np.flatnonzero(valid)
            values[at] += self.weights[bucket[at].astype(np.int64)]
        scores = np.add.reduceat(values, starts, axis=0)
        letter = code != 0
        count = np.add.reduceat(letter.astype(np.int64), starts)
        found = count > 0
        at, sizes = np.flatnonzero(letter), ends - starts
        kinds = _SCRIPT[np.searchsorted(_STARTS, code[at], "right") - 1]
        word = np.repeat(np.arange(len(words)), sizes)[at]
        kind = np.bincount(word * len(SCRIPT_NAMES) + kinds, minlength=len(words) * len(SCRIPT_NAMES)).reshape(len(words), -1).argmax(axis=1)
        candidate = self.scripts[:, kind].T | ~found[:, None]
        none = ~candidate.any(axis=1)
        candidate[none] = True
        scores[none] = 0  # a script of no learned language tells nothing
        scores[~candidate] = -np.inf
        odds = scores.max(axis=1)
        scores -= odds[:, None]
        scores = np.maximum(scores, -1000.0)
        scores[~found] = 0
        odds[none] = np.nan
        return scores, count, odds


def _settled(scores: np.ndarray, penalty: float) -> int:
    """The language that surely labels all words, or -1.

    m stretches in other languages cost m changes or more if some word has the
    best language, else m - 1 of at least two. So nothing is gained by leaving
    it if no stretch of words favours any single other one by half the penalty.
    """
    n, k = scores.shape
    best = int(scores.sum(axis=0).argmax())
    if k == 1 or not n:
        return best
    gain = np.zeros((n + 1, k))
    np.cumsum(scores - scores[:, best:best + 1], axis=0, out=gain[1:])
    return best if (gain - np.minimum.accumulate(gain, axis=0)).max() < penalty / 2 else -1


def viterbi(texts: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best language of each word of each text; a change from one word to the next costs ``penalty``.

    Ties stay with the language at hand, else go to the first. Texts that need
    the full recursion take their steps side by side, longest first.
    """
    paths: list = [None] * len(texts)
    open_ = []
    for i, scores in enumerate(texts):
        best = _settled(scores, penalty)
        if best < 0:
            open_.append(i)
        else:
            paths[i] = np.full(len(scores), best)
    open_.sort(key=lambda i: -len(texts[i]))
    for part in _parts(open_, texts):
        sizes = np.array([len(texts[i]) for i in part])
        k = texts[part[0]].shape[1]
        block = np.zeros((sizes[0], len(part), k))
        for c, i in enumerate(part):
            block[:sizes[c], c] = texts[i]
        came = np.empty((sizes[0], len(part), k), np.uint8 if k < 256 else np.int32)
        value, same = block[0].copy(), np.arange(k)
        alive = (sizes[None, :] > np.arange(sizes[0])[:, None]).sum(axis=1)
        for t in range(1, sizes[0]):
            v = value[:alive[t]]
            top = v.argmax(axis=1)
            left = v.max(axis=1)[:, None] - penalty
            stay = v >= left
            came[t, :alive[t]] = np.where(stay, same, top[:, None])
            value[:alive[t]] = np.where(stay, v, left) + block[t, :alive[t]]
        for c, i in enumerate(part):
            path = np.empty(sizes[c], np.int64)
            path[-1] = value[c].argmax()
            own = came[:, c]
            for t in range(sizes[c] - 1, 0, -1):
                path[t - 1] = own[t, path[t]]
            paths[i] = path
    return paths


def _parts(order: list[int], texts: list[np.ndarray]):
    """Runs of ``order`` whose padded block stays within CELLS_AT_ONCE; one text at least."""
    at = 0
    while at < len(order):
        rows, k = texts[order[at]].shape
        step = max(1, CELLS_AT_ONCE // (rows * k))
        yield order[at:at + step]
        at += step


class Labeller(dict):
    """word -> row of the score table, with words scored once and kept up to a bound."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self.scores = np.zeros((1, len(model.languages)))
        self.letters = np.zeros(1, np.int64)
        self.odds = np.zeros(1)
        self.used = 0

    def rows(self, texts: list[list[str]]) -> None:
        new = list({w for words in texts for w in words if w not in self})
        if not new:
            return
        scores, letters, odds = self.model.word_scores(new)
        if self.used + len(new) > len(self.letters):
            size = max(2 * len(self.letters), self.used + len(new))
            for name in ("scores", "letters", "odds"):
                old = getattr(self, name)
                bigger = np.zeros((size, *old.shape[1:]), old.dtype)
                bigger[:self.used] = old[:self.used]
                setattr(self, name, bigger)
        self.scores[self.used:self.used + len(new)] = scores
        self.letters[self.used:self.used + len(new)] = letters
        self.odds[self.used:self.used + len(new)] = odds
        self.update(zip(new, range(self.used, self.used + len(new))))
        self.used += len(new)

    def label(self, texts: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each text: (language index, letters, scores, log-odds) of each word that has letters.

        Words in a script of no learned language get the index after the last one.
        """
        self.rows(texts)
        places = [np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in texts]
        places = [at[self.letters[at] > 0] for at in places]
        scores = [self.scores[at] for at in places]
        odds = [self.odds[at] for at in places]
        paths = [np.where(np.isnan(o), len(self.model.languages), path) for path, o in zip(viterbi(scores, SWITCH), odds)]
        return list(zip(paths, [self.letters[at] for at in places], scores, odds))

    def predict(self, texts: list[list[str]]) -> list[tuple[str, float]]:
        found, names = [], self.model.languages
        for path, letters, scores, odds in self.label(texts):
            share = np.bincount(path, weights=letters, minlength=len(names) + 1)
            best = int(share.argmax())
            if not len(path) or best == len(names):
                found.append((UNKNOWN, 0.0))
                continue
            total = scores.sum(axis=0)
            certain = 1.0 / float(np.exp(np.clip(total - total[best], -60, 60)).sum())
            own = path == best
            fit = self.model.fit(best, float((odds[own] + scores[own, best]).sum()), float(share[best]))
            found.append((names[best], float(share[best] / share.sum()) * (0.5 + 0.5 * certain) * fit))
        return found

    def trim(self) -> None:
        if self.used > CACHED_WORDS:
            self.clear()
            self.used = 0
            self.scores, self.letters, self.odds = self.scores[:1] * 0, self.letters[:1] * 0, self.odds[:1] * 0


def held_out(key: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, label: str = "lang", text: str = "text", key: str = "doc_id") -> Model:
    """Learn from labelled rows; where a language has over SAMPLE_PER_LANGUAGE, from about so many, chosen by hash.

    Null texts and null labels teach nothing. Counts are made by Spark; the
    model has BUCKETS rows and a column for each language.
    """
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(label).cast("string").alias("l"), F.col(text).cast("string").alias("t"),
        F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.col(text).cast("string")), 11).alias("h"))
    chosen = F.lit(False)
    for row in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect():
        bound = (1 << 53) * min(SAMPLE_PER_LANGUAGE, row["n"]) // row["n"]
        chosen = chosen | ((F.col("l") == row["l"]) & (F.col("h") < bound))
    sample = rows.where(chosen)
    schema = "l string, script boolean, b int, n bigint"

    def each(batches, names):
        grams: dict[str, np.ndarray] = {}
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.setdefault(lang, []).append(words)
            for lang, own in texts.items():
                code, _, _ = letters_of(own)
                counts = grams.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                for bucket, valid in gram_buckets(code):
                    counts[:BUCKETS] += np.bincount(bucket[valid].astype(np.int64), minlength=BUCKETS)
                kind = _SCRIPT[np.searchsorted(_STARTS, code[code != 0], "right") - 1]
                counts[BUCKETS:] += np.bincount(kind, minlength=len(SCRIPT_NAMES))
        for lang, counts in grams.items():
            at = np.flatnonzero(counts)
            yield batch_of(names, [[lang] * len(at), at >= BUCKETS, at % BUCKETS, counts[at]])

    found = map_batches(sample, ["l", "t"], each, schema).groupBy("l", "script", "b").agg(F.sum("n").alias("n"))
    counted = found.toPandas()
    languages = sorted(counted["l"].unique())
    counts = np.zeros((BUCKETS, len(languages)))
    scripts = np.zeros((len(languages), len(SCRIPT_NAMES)))
    for i, lang in enumerate(languages):
        own = counted[counted["l"] == lang]
        counts[own.loc[~own["script"], "b"], i] = own.loc[~own["script"], "n"]
        scripts[i, own.loc[own["script"], "b"]] = own.loc[own["script"], "n"]
    weights = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0, keepdims=True) + SMOOTHING * BUCKETS) + np.log(BUCKETS)
    letters = np.maximum(1, scripts.sum(axis=1))
    chance, own = weights.mean(axis=0) * counts.sum(axis=0) / letters, (counts * weights).sum(axis=0) / letters
    return Model(languages, weights, scripts >= SCRIPT_SHARE * scripts.sum(axis=1, keepdims=True), chance, own, letters)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` rows as (key, lang_pred, score): the language with most letters after Viterbi.

    ``score`` is that language's share of the letters, times a half plus half
    the probability that the whole text's scores give it, times the fit: where
    the log-odds a letter of its words lie between those of a background of
    equal odds and those of the language's own text. A text that is null, has
    no letter, is mostly in scripts of no learned language, or meets a model
    without languages is ``und`` with 0. Rows are kept one for one.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, lang_pred string, score double"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches, names):
        labeller = Labeller(shared.value)
        for batch in batches:
            if not labeller.model.languages:
                yield batch_of(names, [batch.column(0).to_pylist(), [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows])
                continue
            texts = [t.split() for t in batch.column(1).to_pylist()]
            found = labeller.predict(texts)
            yield batch_of(names, [batch.column(0).to_pylist(), [f[0] for f in found], [f[1] for f in found]])
            labeller.trim()

    return map_batches(docs, [key, text_or_empty(text)], each, schema)


def spans(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_word, n_words, lang): the stretches of one language in each text, words being split at white space.

    Words without letters belong to no stretch and don't end one. Words in a
    script of no learned language are ``und``.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, start_word bigint, n_words bigint, lang string"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches, names):
        labeller = Labeller(shared.value)
        for batch in batches:
            texts = [t.split() for t in batch.column(1).to_pylist()]
            out, labels = [], labeller.label(texts) if labeller.model.languages else []
            for doc, words, (path, *_) in zip(batch.column(0).to_pylist(), texts, labels):
                place = np.flatnonzero([labeller.letters[labeller[w]] > 0 for w in words])
                cuts = np.flatnonzero(np.diff(path)) + 1
                for part in np.split(np.arange(len(path)), cuts) if len(path) else []:
                    out.append((doc, int(place[part[0]]), int(place[part[-1]] - place[part[0]] + 1),
                                [*labeller.model.languages, UNKNOWN][path[part[0]]]))
            if out:
                yield batch_of(names, list(zip(*out)))
            labeller.trim()

    return map_batches(docs, [key, text_or_empty(text)], each, schema)


def predict_held_out(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of all rows, learned from the rows that aren't held out."""
    model = train(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """``docs`` without rows whose text is ``und`` or whose score is under ``least``; nothing is shuffled."""
    shared, learned = docs.sparkSession.sparkContext.broadcast(model), bool(model.languages)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept_tables(__name__)
        labeller = Labeller(shared.value)
        for batch in batches:
            out: list[float] = []
            for at in range(0, len(batch), ROWS_AT_ONCE):
                texts = [t.split() for t in batch.slice(at, ROWS_AT_ONCE).to_pylist()]
                found = labeller.predict(texts) if learned else [(UNKNOWN, 0.0)] * len(texts)
                out += [-1.0 if lang == UNKNOWN else value for lang, value in found]
                labeller.trim()
            yield pa.array(out, pa.float64())

    return docs.where(score(text_or_empty(text)) >= least).select(*docs.columns)
