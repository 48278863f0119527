"""Languages of documents and of their mixed parts, by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The score of
a word is the sum over all its segmentations into pieces (forward algorithm), one number for
each language; as no piece crosses white space, a text's score is the sum over its words, and
a worker scores each distinct word once. Piece probabilities are trained by EM on a bounded
sample of labelled documents, cut into sentences; wrong labels and mixed documents are outvoted
before, by labelling each sentence anew with a model of whole words.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
LANGS = ("en", "de", "fr", "es", "pt", "nl")
#: Training sees at most this many documents of each label, whole.
SAMPLE_DOCS = 150
EM_ROUNDS, CACHE_WORDS = 2, 200_000
#: Forward sums are scaled anew after so many letters, so that words of any length stay within floats.
SCALED = 16
#: A word counts for at most CLIP nats for or against a language; a part of a text in another language needs PART nats.
#: A whole sentence in another language needs SENTENCE nats.
CLIP, PART, SENTENCE, MIN_WORDS = 6.0, 16.0, 6.0, 4
#: A word in fewer than KNOWN sentences of the sample (often a name, which has no language) counts for at most RARE nats.
KNOWN, RARE = 3, 1.5
CLEANED, PRIOR = 4, 2.0
# Accepted names of the languages: English name, two-letter and three-letter codes.
NAMES = {
    "en": ("english", "en", "eng"), "de": ("german", "de", "deu", "ger"), "fr": ("french", "fr", "fra", "fre"),
    "es": ("spanish", "es", "spa"), "pt": ("portuguese", "pt", "por"), "nl": ("dutch", "nl", "nld", "dut"),
}
# Frequent function words, which start the cleaning of the training labels.
FUNCTION_WORDS = {
    "en": "the of and to is was that it for with this are have had they when where who because which while".split(), "de": "der die das und ist nicht mit ein eine zu den von auf dem wir sich wird auch noch was er sie".split(),
    "fr": "le les des et est une dans pour qui pas sur avec il elle nous du sont cette la en que ce un de je au".split(), "es": "el los las una por con para del se y lo su fue está pero más este la en que no un de".split(),
    "pt": "o os um uma não em com do da dos na ao foi mas mais ele ela você por que para no se de".split(), "nl": "het een van dat niet op te voor zijn er aan wij ze naar ook nog wordt deze die was door en is de".split(),
}
_BASE, _ONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)
_WORD = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+|\n")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_HEADING = re.compile(r"\s*#{1,6}\s|\s*[^\W\d_]+(?:\s+[^\W\d_]+){0,2}(?:\s+\d{4}-\d\d)?\s*$")
_ROLE_RE2 = r"(?m)^\s*(?:user|assistant|human|system)\s*:\s*"
_ROLE = re.compile(r"^\s*(?:user|assistant|human|system)\s*:\s*|^\s*[-*•]\s+", re.I | re.M)


def label_language(label: str) -> Column:
    """The language that a label names by code, code with region or English name; null if none of ours."""
    code = F.regexp_extract(F.lower(F.trim(F.col(label))), r"^([a-z]+)(?:[-_][a-z0-9]+)*$", 1)
    out = F.lit(None).cast("string")
    for lang, names in NAMES.items():
        out = F.when(code.isin(*names), lang).otherwise(out)
    return out


def vocabulary(folder: str = TOKENIZERS) -> list[str]:
    """Pieces of the public vocabulary in lower case, '▁' marking a word's begin, and all single letters."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, "piece_bpe_32k.model"))
    pieces = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    letters = set("▁abcdefghijklmnopqrstuvwxyzàâäáãåæçèéêëìíîïñòóôöõøœùúûüýÿß'’")
    return sorted({p for p in pieces if p and "▁" not in p[1:]} | letters)


class Scorer:
    """Log probabilities of words in each language, all segmentations summed."""

    def __init__(self, pieces: list[str], probs: np.ndarray, known: frozenset[str] | None = None):
        self.known = known
        self.number = {p: i for i, p in enumerate(pieces)}
        self.probs = probs  # (pieces + 1, languages); the last row is for an unknown letter
        self.padded = np.vstack([probs, np.zeros(probs.shape[1])])  # and one for no piece at all
        self.by_length = {}
        self.longest = max(map(len, pieces))
        for k in range(1, self.longest + 1):
            own = [p for p in pieces if len(p) == k]
            rolling = np.zeros(len(own), np.uint64)
            for i in range(k):
                rolling = rolling * _BASE + np.array([ord(p[i]) for p in own], np.uint64) + _ONE
            order = np.argsort(rolling)
            keys, ids = rolling[order], np.array([self.number[p] for p in own], np.int64)[order]
            self.by_length[k] = (np.append(keys, np.uint64(2**64 - 1)), np.append(ids, len(pieces) + 1))
        self.row: dict[str, int] = {"": 0}  # the empty word scores nothing
        self.table = np.zeros((4_096, probs.shape[1]), dtype=np.float32)

    def lattice(self, word: str) -> list[tuple[int, int, int]]:
        """Edges (from, to, piece) of all segmentations, in order of their ends."""
        w, get, unknown = "▁" + word, self.number.get, len(self.number)
        out = []
        for j in range(1, len(w) + 1):
            any_ = False
            for i in range(max(0, j - self.longest), j):
                if (p := get(w[i:j])) is not None:
                    out.append((i, j, p))
                    any_ = True
            if not any_:
                out.append((j - 1, j, unknown))
        return out

    def forward(self, word: str, edges: list) -> np.ndarray:
        alpha = np.zeros((len(word) + 2, self.probs.shape[1]))
        alpha[0] = 1.0
        for i, j, p in edges:
            alpha[j] += alpha[i] * self.probs[p]
        return alpha

    def score(self, words: list[str]) -> np.ndarray:
        """Log probabilities of words of one length, centred on their mean and clipped (any word has bounded weight).

        All words go through the forward sums together; pieces are looked up by rolling hashes of
        the words' code points, length by length.
        """
        n, size = len(words), len(words[0]) + 1
        points = np.array(["▁" + w for w in words], dtype=f"U{size}").view(np.uint32).reshape(n, size).astype(np.uint64)
        found, rolling = [], np.zeros((n, size + 1), np.uint64)
        for k in range(1, min(size, self.longest) + 1):
            rolling = rolling[:, :-1] * _BASE + points[:, k - 1 :] + _ONE
            keys, pieces = self.by_length[k]
            at = np.searchsorted(keys, rolling)
            found.append(np.where(keys[at] == rolling, pieces[at], len(self.number) + (k > 1)))
        alpha, scale = np.zeros((size + 1, n, self.probs.shape[1])), np.zeros((n, 1))
        alpha[0] = 1.0
        for j in range(1, size + 1):
            for k in range(1, min(j, self.longest) + 1):
                alpha[j] += alpha[j - k] * self.padded[found[k - 1][:, j - k]]
            if j % SCALED == 0:
                most = alpha[j].max(1, keepdims=True)
                alpha[max(0, j - self.longest) : j + 1] /= most
                scale += np.log(most)
        s = np.log(alpha[-1] + 1e-300) + scale
        return np.clip(s - s.mean(1, keepdims=True), -CLIP, CLIP)

    def learn(self, words: set[str]) -> None:
        """Score the words not yet known."""
        if len(self.row) > CACHE_WORDS:
            self.row = {"": 0}
        lengths: dict[int, list[str]] = {}
        row = self.row
        for w in [w for w in words if w not in row]:
            lengths.setdefault(len(w), []).append(w)
        for size, ws in lengths.items():
            most = max(1, 40_000 // (size + 1))  # words at once: so many letters
            for at in range(0, len(ws), most):
                part = ws[at : at + most]
                n = len(self.row)
                while n + len(part) > len(self.table):
                    self.table = np.vstack([self.table, np.zeros_like(self.table)])
                own = self.score(part)
                if self.known is not None:
                    rare = [w not in self.known for w in part]
                    own[rare] = np.clip(own[rare], -RARE, RARE)
                self.table[n : n + len(part)] = own
                self.row.update(zip(part, range(n, n + len(part))))

    def scores(self, words: list[str]) -> np.ndarray:
        """One row for each word; each distinct word is scored once while the cache lasts."""
        row = self.row
        try:
            return self.table[np.fromiter(map(row.__getitem__, words), np.int32, len(words))]
        except KeyError:
            self.learn(set(words))
            return self.table[[self.row[w] for w in words]]


def train(counts: dict[str, np.ndarray], pieces: list[str]) -> np.ndarray:
    """Piece probabilities by EM from the words' counts in each language."""
    k = len(LANGS)
    mass = np.full((len(pieces) + 1, k), 1e-7)
    lengths = np.array([len(p) for p in pieces] + [1.0])
    probs = np.repeat((np.exp(-0.5 * lengths) / np.exp(-0.5 * lengths).sum())[:, None], k, axis=1)
    for _ in range(EM_ROUNDS):
        s = Scorer(pieces, probs)
        mass[:] = 0.02
        for word, n in counts.items():
            edges = s.lattice(word)
            alpha = s.forward(word, edges)
            beta = np.zeros_like(alpha)
            beta[-1] = 1.0
            share = n / np.maximum(alpha[-1], 1e-300)  # beyond some hundred letters a word's share fades away
            for i, j, p in reversed(edges):
                out = probs[p] * beta[j]
                beta[i] += out
                mass[p] += alpha[i] * out * share
        probs = mass / mass.sum(0)
    return probs


def text_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


Model = tuple[list[str], np.ndarray, frozenset[str]]


def fit(documents: DataFrame, folder: str = TOKENIZERS) -> Model:
    """Pieces, their probabilities in each language and the words known well, from at most SAMPLE_DOCS documents of each label.

    The sample holds the documents with the smallest hashes of their text, so it is the same
    whatever the partitions are. Languages without a labelled document get the common mean.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy("h", "text")
    sample = (
        documents.select(label_language("lang").alias("label"), "text")
        .where("label is not null and text is not null").withColumn("h", F.xxhash64("text"))
        .withColumn("r", F.row_number().over(w)).where(F.col("r") <= SAMPLE_DOCS).select("label", "text").collect()
    )
    return learn([(r["label"], r["text"]) for r in sample], folder)


def _sentences(labelled: list[tuple[str, str]]) -> list[tuple[int, Counter]]:
    """(language, words) of all sentences. Labels are wrong for some documents and for parts of mixed ones, so the sentences outvote them.

    Function words tell the first language of a sentence, or else that of its document; the label counts where
    they say nothing at all. A naive Bayes model of whole words is fitted to that and labels each sentence anew, CLEANED times; the language of its document speaks for a sentence by PRIOR nats.
    """
    docs = [(LANGS.index(lang), [c for x in _BREAK.split(_ROLE.sub("", text)) if (c := Counter(text_words(x)))]) for lang, text in labelled]
    now = [(lang, c) for lang, cs in docs for c in cs]
    number: dict[str, int] = {}
    for _, c in now:
        for w in c:
            number.setdefault(w, len(number))
    at = [(np.array([number[w] for w in c]), np.array(list(c.values()), float)) for _, c in now]
    mine = np.array([k for k, (_, cs) in enumerate(docs) for _ in cs])
    told = np.array([[sum(c[w] for w in ws) for ws in FUNCTION_WORDS.values()] for _, c in now])
    top = np.sort(told, axis=1)
    by_doc = np.zeros((len(docs), len(LANGS)))
    np.add.at(by_doc, mine, told)
    main = np.where(by_doc.max(1) > 0, by_doc.argmax(1), [lang for lang, _ in docs])
    # a sentence that few function words tell begins with the language of its document
    labels = np.where(top[:, -1] - top[:, -2] >= 2, told.argmax(1), main[mine])
    for _ in range(CLEANED):
        counts = np.zeros((len(number), len(LANGS)))
        for lang, (ws, ns) in zip(labels, at):
            counts[ws, lang] += ns
        logs = np.log(counts / np.maximum(counts.sum(0), 1) + 1e-5)  # a word that no language has speaks for none
        scores = np.array([ns @ logs[ws] for ws, ns in at])
        whole = np.zeros((len(docs), len(LANGS)))
        np.add.at(whole, mine, scores)
        main = whole.argmax(1)
        labels = (scores + PRIOR * np.eye(len(LANGS))[main[mine]]).argmax(1)
    return [(int(lang), c) for lang, (_, c) in zip(labels, now)]


def learn(labelled: list[tuple[str, str]], folder: str = TOKENIZERS) -> Model:
    """The model of a sample of (language, text)."""
    pieces = vocabulary(folder)
    sentences = _sentences(labelled) if labelled else []
    counts: dict[str, np.ndarray] = {}
    for lang, c in sentences:
        for word, n in c.items():
            counts.setdefault(word, np.zeros(len(LANGS)))[lang] += n
    # square roots keep frequent words from drowning the rest
    probs = train({x: np.sqrt(n) for x, n in counts.items()} or {"a": np.ones(len(LANGS))}, pieces)
    seen = Counter(w for _, c in sentences for w in c)
    return pieces, probs, frozenset(w for w, n in seen.items() if n >= KNOWN)


def _posterior(total: np.ndarray) -> np.ndarray:
    e = np.exp(np.clip(total - total.max(), -700, 0))
    return e / e.sum()


def _other_part(scores: np.ndarray, main: int) -> bool:
    """Whether some stretch of words is better by SENTENCE in another language than in ``main``.

    Every part in another language is such a stretch, so a text without one has none.
    """
    cum = (scores - scores[:, main : main + 1]).cumsum(axis=0, dtype=np.float64)
    low = np.minimum(np.minimum.accumulate(cum, axis=0), 0)
    return bool(((cum[1:] - low[:-1]) >= SENTENCE).any())


def split_languages(scores: np.ndarray, ends: set[int]) -> list[tuple[int, int, int]]:
    """Stretches (begin, end, language) of a paragraph by Viterbi; a change costs less where a sentence begins (``ends``)."""
    n, k = scores.shape
    best, back = scores[0].copy(), np.zeros((n, k), dtype=np.int8)
    for i in range(1, n):
        top = int(best.argmax())
        jump = best[top] - (4.0 if i in ends else 10.0)
        stay = best >= jump
        back[i] = np.where(stay, np.arange(k), top)
        best = np.where(stay, best, jump) + scores[i]
    at, end, out = int(best.argmax()), n, []
    for i in range(n - 1, -1, -1):
        before = int(back[i, at]) if i else -1
        if before != at:
            out.append((i, end, at))
            end = i
        at = before
    return out[::-1]


def paragraph_parts(text: str, scorer: Scorer, label: str | None = None, every: np.ndarray | None = None) -> list[tuple[int, int, float, int]]:
    """(paragraph, language, confidence, words) of each paragraph and language in it.

    Paragraphs are blocks between blank lines, numbered from 1; headings are numbered but have no
    rows. A stretch counts as a language of its paragraph if it is a sentence of MIN_WORDS words
    and SENTENCE nats over the paragraph's main language, or any stretch of PART nats.
    With ``label``, a text that is in that language alone gives no rows. ``every`` has the scores of
    all words in order, if the caller has them already.
    """
    if every is None:
        every = scorer.scores(text_words(_ROLE.sub("", text)))
    if not every.any():
        return []
    total = every.sum(0, dtype=np.float64)
    main = int(total.argmax())
    pure = not _other_part(every, main)
    if pure and label == LANGS[main]:
        return []
    rows: list[tuple[int, str]] = []
    for no, p in enumerate((p for p in _PARAGRAPH.split(text.strip()) if p.strip()), 1):
        if _HEADING.match(p) and "\n" not in p.strip():
            continue
        if p.lstrip().startswith("#"):
            p = p.lstrip().split("\n", 1)[1]
        p = _ROLE.sub("", p)
        if _WORD.search(p):
            rows.append((no, p))
    if pure:
        c = float(_posterior(total)[main])
        return [(no, main, c, len(text_words(p))) for no, p in rows]
    out: list[tuple[int, int, float, int]] = []
    for no, p in rows:
        s = scorer.scores(text_words(p))
        sums = s.sum(0, dtype=np.float64)
        top = int(sums.argmax())
        if sums[top] - sums[main] < SENTENCE:
            top = main
        found: dict[int, list] = {}
        if _other_part(s, top):
            starts, n = {0}, 0
            for sentence in _BREAK.split(p):
                n += len(text_words(sentence))
                starts.add(n)
            s = s.astype(np.float64)
            parts = split_languages(s, starts)
            weight = Counter()
            for a, b, lang in parts:
                weight[lang] += b - a
            top = max(weight, key=lambda x: (weight[x], x == main, -x))
            for a, b, lang in parts:
                gain = s[a:b, lang].sum() - s[a:b, top].sum()
                least = SENTENCE if a in starts and b in starts else PART
                if lang == top or (b - a >= MIN_WORDS and gain >= least):
                    found.setdefault(lang, []).append((a, b))
        else:
            found[top] = [(0, len(s))]
        for lang, spans in found.items():
            part = sum((s[a:b].sum(0, dtype=np.float64) for a, b in spans), np.zeros(s.shape[1]))
            out.append((no, lang, float(_posterior(part)[lang]), sum(b - a for a, b in spans)))
    if label is not None and all(LANGS[r[1]] == label for r in out):
        return []
    return out


def batch_scores(texts: pa.Array, scorer: Scorer) -> tuple[np.ndarray, np.ndarray]:
    """Scores of all words of all texts in order, and where each text's words begin and end.

    Arrow splits the texts and numbers the words, so only distinct words become Python strings.
    """
    bare = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), _ROLE_RE2, "")
    lists = pc.split_pattern_regex(bare, r"\P{L}+")
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    scorer.learn(set(distinct))
    own = scorer.table[np.fromiter(map(scorer.row.__getitem__, distinct), np.int32, len(distinct))]
    ends = lists.offsets.to_numpy()
    return own[coded.indices.to_numpy()], ends - ends[0]


_kept: list = []


def _labeller(bc, wrong_only: bool):
    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bc.value
        if not _kept or _kept[0] is not model:  # a worker keeps the known words for its later tasks
            _kept[:] = [model, Scorer(*model)]
        scorer = _kept[1]
        for whole in batches:
            out = []
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                scores, ends = batch_scores(b.column(1), scorer)
                for k, (doc, text, label) in enumerate(zip(*(b.column(i).to_pylist() for i in range(3)))):
                    if text:
                        parts = paragraph_parts(text, scorer, label if wrong_only else None, scores[ends[k] : ends[k + 1]])
                        out += [(doc, no, LANGS[lang], c, n) for no, lang, c, n in parts]
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "para_no", "lang_found", "confidence", "n_words"])

    return labelled


def language_parts(
    documents: DataFrame, model: Model | None = None, folder: str = TOKENIZERS, wrong_only: bool = False
) -> DataFrame:
    """(doc_id, para_no, lang_found, confidence, n_words); ``documents`` has (doc_id, text, lang), other columns are ignored.

    Null texts and texts without a word have no rows. ``wrong_only`` leaves out the documents that are
    in one language, the one of their label. ``model`` is what ``fit`` gives (fitted here if None); it is
    broadcast, its size fixed by the vocabulary.
    """
    bc = documents.sparkSession.sparkContext.broadcast(model or fit(documents, folder))
    return documents.select(F.col("doc_id").cast("bigint"), "text", label_language("lang").alias("label")).mapInArrow(
        _labeller(bc, wrong_only), "doc_id bigint, para_no int, lang_found string, confidence double, n_words int"
    )


def document_languages(parts: DataFrame) -> DataFrame:
    """(doc_id, lang_found, confidence, n_langs): each document's main language by words."""
    per = parts.groupBy("doc_id", "lang_found").agg(F.sum("n_words").alias("n"), F.avg("confidence").alias("c"))
    return per.groupBy("doc_id").agg(
        F.max_by("lang_found", F.struct("n", "lang_found")).alias("lang_found"), F.max_by("c", F.struct("n", "lang_found")).alias("confidence"), F.count("*").alias("n_langs")
    )


def mislabelled(documents: DataFrame, model: Model | None = None, folder: str = TOKENIZERS) -> DataFrame:
    """The parts of all documents whose label is missing, names no language or another, or which hold several languages."""
    return language_parts(documents, model, folder, wrong_only=True)
