"""Language of documents and of their passages: a byte convolutional network in numpy.

The network reads fixed-length windows of bytes: one-hot byte filters of several widths,
max pooling over the window, rectification and a softmax layer.  It is trained on a
bounded sample of labelled rows (``per_language`` documents for each language, chosen by
a hash of the document id, so reruns and repartitionings train the same network) whose
label noise is reduced by dropping windows that contradict the first fit.  It is then
applied to every sentence of every document in batches, inside one ``mapInPandas`` over
the scan; nothing is shuffled.

Defined results: null or empty text, or text without letters, gives no segment and
language null; text in none of ``LANGUAGES`` is ``und``; repeated rows are labelled alike;
ties between languages go to the first in ``LANGUAGES``; extra columns of the input are ignored.
"""

from __future__ import annotations

import io
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.mime import readable_parts

LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "sv", "pl", "ru")
#: None of them: the class of text the network doesn't know, and its code.
OTHER = "und"
CLASSES = (*LANGUAGES, OTHER)

# ISO 639-2 codes and English names of the languages above.
LABEL_NAMES = {
    "en": "eng english",
    "de": "ger deu german",
    "fr": "fre fra french",
    "es": "spa spanish castilian",
    "pt": "por portuguese",
    "it": "ita italian",
    "nl": "dut nld dutch flemish",
    "sv": "swe swedish",
    "pl": "pol polish",
    "ru": "rus russian",
}

# Attribution lines of replies, and stems by which a legal notice is known.
ATTRIBUTION = re.compile(
    r"(?im)^[ \t]*(?:(?:on|am|le|el|em|op|il|den|dnia)[ \t]+)?\d{4}-\d\d-\d\d\b[^\n]{0,120}:[ \t]*$"
    r"|^[ \t]*(?:on|am|le|el|em|op|il|den|dnia)\b[^\n]{0,120}"
    r"(?:wrote|schrieb|a écrit|escribió|escreveu|schreef|ha scritto|skrev|napisał(?:\(a\))?|пишет)[^\n]{0,60}:[ \t]*$"
    r"|^[ \t]*-{3,}[ \t]*\w[\w \t]{3,40}\w[ \t]*-{3,}[ \t]*$"
)
NOTICE_MISTAKE = ("mistake", "in error", "irrt", "par erreur", "por error", "por engano", "per errore", "per ongeluk", "misstag", "przez pomy", "по ошибке")
NOTICE_STEMS = (
    "messag nachricht mensaje mensagem bericht meddeland wiadomo сообщени",
    "addressee recipient empf destin dirigid rivolto bestemd ontvanger mottagar adresat получател",
    "sender absender expéditeur expediteur envi mittente afzender avsändaren avsandaren nadawc отправител",
)

_STEMS = tuple(tuple(x.split()) for x in NOTICE_STEMS)
_QUOTE = re.compile(r"(?m)^[ \t]*(?:[>|:][ \t]?)+")
_PARAGRAPH = re.compile(r"\n[ \t]*\n\s*")
_SENTENCE = re.compile(r"(?<=[.!?…;:])[\"'»”)\]]*\s+")
_RULE = re.compile(r"(?m)^[ \t]*(?:-{2,}|_{5,}|={5,})[ \t]*$")
_WORD = re.compile(r"[^\W_]+")
_CONTACT = re.compile(r"\S@\S|\+\d[\d ()/-]{6,}")

# ---------------------------------------------------------------- text


def clean_passages(raw: str | None) -> list[str]:
    """Paragraphs of the body: quoted text stays, quote marks, attribution lines and
    legal notices go.  A repeated paragraph (the HTML twin of a plain part) is kept; it
    costs nothing, as sentences are classified once."""
    out = []
    for part in readable_parts(raw):
        text = _QUOTE.sub("", part)
        if ":" in text or "---" in text:
            text = ATTRIBUTION.sub("\n", text)
        for p in _PARAGRAPH.split(_RULE.sub("\n\n", text)):
            p = " ".join(p.split())
            if p and not is_signature(p) and not is_notice(p):
                out.append(p)
    return out


def is_signature(paragraph: str) -> bool:
    """A name, or a few words with an e-mail address or a telephone number, and no sentence."""
    if len(paragraph) > 160 or paragraph[-1] in ".!?:;,…":
        return False
    n = paragraph.count(" ") + 1
    return n <= 3 or n <= 20 and bool(_CONTACT.search(paragraph))


def is_notice(paragraph: str) -> bool:
    """A legal notice: it speaks of a mistake, and of two of message, addressee, sender."""
    low = paragraph.lower()
    return any(x in low for x in NOTICE_MISTAKE) and sum(any(x in low for x in stems) for stems in _STEMS) >= 2


def sentences(paragraph: str) -> list[str]:
    return [s for s in _SENTENCE.split(paragraph) if s]


def label_language(label: str | None) -> str | None:
    """The language a label names: any letter case, region, ISO code or English name."""
    if not label:
        return None
    key = re.split(r"[-_ .(]", label.strip().lower(), maxsplit=1)[0]
    return key if key in LANGUAGES else _NAMES.get(key)


_NAMES = {name: code for code, names in LABEL_NAMES.items() for name in names.split()}

# ---------------------------------------------------------------- network

PAD, SPACE = 0, 1


def _byte_symbols() -> np.ndarray:
    """Byte to symbol: letters, the apostrophe and bytes over 127 are told apart; other
    characters, digits among them, say nothing about a language and count as a space."""
    table = np.full(256, SPACE, np.int32)
    letters = [*range(ord("a"), ord("z") + 1), ord("'"), *range(128, 256)]
    table[letters] = np.arange(2, 2 + len(letters))
    return table


SYMBOL = _byte_symbols()
SYMBOLS = int(SYMBOL.max()) + 1
WIDTHS = (2, 3, 4)
WINDOW = 64


def windows_of(texts: list[str], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Symbol windows of each text, and the index of the text of each window.  Texts
    longer than a window are tiled; the last tile ends where the text ends."""
    rows, owner = [], []
    for i, text in enumerate(texts):
        s = SYMBOL[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
        n = len(s)
        if n <= window:
            row = np.zeros(window, np.int32)
            row[:n] = s
            rows.append(row)
            owner.append(i)
        else:
            for a in [*range(0, n - window, window), n - window]:
                rows.append(s[a : a + window])
                owner.append(i)
    if not rows:
        return np.zeros((0, window), np.int32), np.zeros(0, np.int64)
    return np.stack(rows), np.array(owner, np.int64)


class ByteConvNet:
    """``taps[w][k]`` holds, for each symbol, what tap k of the width-w filters adds."""

    def __init__(self, filters: int = 16, classes: int = len(CLASSES), seed: int = 7):
        rng = np.random.default_rng(seed)
        self.filters = filters
        self.params = {f"t{w}": rng.normal(0, 0.25, (w, SYMBOLS, filters)).astype(np.float32) for w in WIDTHS}
        self.params["dense"] = rng.normal(0, 0.2, (filters * len(WIDTHS), classes)).astype(np.float32)
        self.params["bias"] = np.zeros(classes, np.float32)
        for w in WIDTHS:
            self.params[f"t{w}"][:, PAD] = 0

    # forward keeps the place of each maximum, through which alone the gradient flows
    def _forward(self, x: np.ndarray):
        pooled, places = [], []
        for w in WIDTHS:
            t, n = self.params[f"t{w}"], x.shape[1] - w + 1
            act = t[0][x[:, :n]]
            for k in range(1, w):
                act += t[k][x[:, k : k + n]]
            at = act.argmax(1)
            places.append(at)
            pooled.append(np.take_along_axis(act, at[:, None, :], 1)[:, 0])
        h = np.maximum(np.concatenate(pooled, 1), 0)
        return h, places, _softmax(h @ self.params["dense"] + self.params["bias"])

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 256, rate: float = 0.02, seed: int = 1) -> None:
        """``steps`` minibatches of Adam; the work does not depend on the sample's size."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.params.items()}
        s = {k: np.zeros_like(v) for k, v in self.params.items()}
        order, at = rng.permutation(len(x)), 0
        for step in range(1, steps + 1):
            if at + batch > len(order):
                order, at = rng.permutation(len(x)), 0
            pick = order[at : at + batch]
            at += batch
            xb, yb = x[pick], y[pick]
            h, places, p = self._forward(xb)
            d = p
            d[np.arange(len(pick)), yb] -= 1
            d /= len(pick)
            grad = {"dense": h.T @ d, "bias": d.sum(0)}
            dh = (d @ self.params["dense"].T) * (h > 0)
            f = np.arange(self.filters)
            for i, w in enumerate(WIDTHS):
                g = np.zeros_like(self.params[f"t{w}"])
                dw = dh[:, i * self.filters : (i + 1) * self.filters]
                for k in range(w):
                    symbols = np.take_along_axis(xb, places[i] + k, 1)
                    np.add.at(g[k], (symbols, f[None, :]), dw)
                g[:, PAD] = 0
                grad[f"t{w}"] = g
            lr = rate * (1 - step / (steps + 1)) ** 0.5
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                self.params[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)

    def compile(self) -> None:
        """Sums of neighbouring taps as tables over symbol pairs: one look-up for two taps."""
        pair = lambda t: (t[0][:, None, :] + t[1][None, :, :]).reshape(SYMBOLS * SYMBOLS, -1)
        t2, t3, t4 = (self.params[f"t{w}"] for w in WIDTHS)
        self.first = np.ascontiguousarray(np.concatenate([pair(t2), pair(t3[:2]), pair(t4[:2])], 1))
        self.third = np.ascontiguousarray(t3[2])
        self.last = np.ascontiguousarray(pair(t4[2:]))

    def predict(self, x: np.ndarray, chunk: int = 48) -> np.ndarray:
        """Probabilities of each window, by the compiled tables."""
        out, f = [], self.filters
        for a in range(0, len(x), chunk):
            s = x[a : a + chunk]
            n = s.shape[1] - 3
            pairs = s[:, :-1] * SYMBOLS + s[:, 1:]
            act = self.first.take(pairs[:, :n], axis=0)
            act[:, :, f : 2 * f] += self.third.take(s[:, 2 : 2 + n], axis=0)
            act[:, :, 2 * f :] += self.last.take(pairs[:, 2 : 2 + n], axis=0)
            h = np.maximum(act.max(1), 0)
            out.append(_softmax(h @ self.params["dense"] + self.params["bias"]))
        return np.concatenate(out) if out else np.zeros((0, len(CLASSES)), np.float32)


def save(net: ByteConvNet, spark: SparkSession, path: str) -> None:
    """Weights as a table of one row, in any folder Spark can write to."""
    buffer = io.BytesIO()
    np.savez(buffer, filters=net.filters, **net.params)
    spark.createDataFrame([(bytearray(buffer.getvalue()),)], "weights binary").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> ByteConvNet:
    with np.load(io.BytesIO(bytes(spark.read.parquet(path).first()["weights"]))) as kept:
        net = ByteConvNet(int(kept["filters"]))
        net.params = {k: kept[k] for k in kept.files if k != "filters"}
    net.compile()
    return net


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


# ---------------------------------------------------------------- training

_FOLD = str.maketrans("łøđß", "lods")
_VOWELS = frozenset("aeiouyæœаеиоуыэюя")


def strip_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).translate(_FOLD)


def spoil(text: str, how: int) -> str:
    """Damage met in archives: accents lost, or bytes read in the wrong character set."""
    if how == 0:
        return strip_accents(text)
    try:
        if how == 1:
            return text.encode("utf-8").decode("cp1252", "replace")
        if how == 2:
            return text.encode("utf-8").decode("latin-1")
        return text.encode("cp1251" if re.search("[а-я]", text) else "cp1252", "replace").decode("koi8-r" if how == 3 else "latin-1")
    except UnicodeError:
        return text


def strange(text: str, rng: np.random.Generator) -> str:
    """The text in a language that is not there: its vowels stand for each other, and so do
    its consonants, in an order drawn anew."""
    low = text.lower()
    letters = sorted({c for c in low if c.isalpha()})
    plain = {c: strip_accents(c)[:1] for c in letters}
    own = {}
    for group in ([c for c in letters if plain[c] in _VOWELS], [c for c in letters if plain[c] not in _VOWELS]):
        own.update(zip(group, [group[i] for i in rng.permutation(len(group))]))
    return "".join(own.get(c, c) for c in low)


def train(texts: list[str], labels: list[str], steps: int = 700, seed: int = 7, others: float = 0.3) -> ByteConvNet:
    """Fits on the sentences of labelled documents; one sentence in four is spoilt, and a
    share ``others`` is there once more in a strange language, to tell what is none of
    ``LANGUAGES``.  The first half of the steps sees all windows, the second only those whose label the first
    fit gives at least a twentieth.  Classes are weighted alike by resampling."""
    rng = np.random.default_rng(seed)
    sample, y = [], []
    for text, label in zip(texts, labels):
        for s in dict.fromkeys(s for p in clean_passages(text) for s in sentences(p) if len(s) >= 30):
            r = rng.random()
            sample.append(spoil(s, int(r * 20)) if r < 0.25 else s)
            y.append(LANGUAGES.index(label))
            if rng.random() < others:
                sample.append(strange(s, rng))
                y.append(len(LANGUAGES))
    net = ByteConvNet(seed=seed)
    x, owner = windows_of(sample)
    if not len(x):
        net.compile()
        return net
    target = np.array(y)[owner]
    for part in range(2):
        if part:
            net.compile()
            likely = net.predict(x)[np.arange(len(x)), target] >= 0.05
            x, target = x[likely], target[likely]
            if not len(x):
                break
        counts = np.bincount(target, minlength=len(CLASSES))
        each = max(256 // len(CLASSES) + 1, int(np.median(counts[counts > 0])))
        pick = np.concatenate([rng.choice(np.flatnonzero(target == c), each) for c in range(len(CLASSES)) if counts[c]])
        net.fit(x[pick], target[pick], steps // 2, rate=0.02 if not part else 0.01, seed=seed + part)
    net.compile()
    return net


def training_sample(docs: DataFrame, per_language: int = 150, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> tuple[list[str], list[str]]:
    """At most ``per_language`` labelled documents of each language, those with the least
    hash of their id.  Each language's hash bound follows from its row count, so only
    about the rows wanted are read and none is ranked."""
    spelt = [(n, c) for c, names in LABEL_NAMES.items() for n in (c, *names.split())]
    known = F.create_map(*[F.lit(x) for pair in spelt for x in pair])
    key = F.lower(F.regexp_extract(F.trim(F.col(lang)), r"^([A-Za-z]+)", 1))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.try_element_at(known, key).alias("code")).where("code is not null and text is not null")
    counts = {r["code"]: r["count"] for r in rows.groupBy("code").count().collect()}
    unit = F.conv(F.substring(F.md5(F.concat(F.lit("language sample/"), F.col("id").cast("string"))), 1, 12), 16, 10).cast("double") / 16.0**12
    bound = F.lit(0.0)
    for c, n in counts.items():
        bound = F.when(F.col("code") == c, F.lit(1.3 * per_language / n)).otherwise(bound)
    got = rows.withColumn("unit", unit).where(F.col("unit") < bound).toPandas()
    got = got.sort_values(["unit", "id"]).groupby("code", sort=True).head(per_language)
    return got["text"].tolist(), got["code"].tolist()


# ---------------------------------------------------------------- application

SWITCH = 5.0
#: A sentence (a name, a telephone number) whose best language is less sure than this follows its neighbours.
LEAST_SURE = 0.5
#: Characters from which a sentence's evidence counts in full.
FULL_WEIGHT = 48


def _path(scores: np.ndarray, switch: float) -> np.ndarray:
    """The best sequence of languages for sentences in order, each change costing ``switch``."""
    best = scores.argmax(1)
    told = scores.any(1)
    if told.any() and (best[told] == best[told][0]).all():
        return np.full(len(best), best[told][0])
    total, back = scores[0].copy(), []
    for s in scores[1:]:
        top = int(total.argmax())
        stay = total >= total[top] - switch
        back.append(np.where(stay, np.arange(len(total)), top))
        total = np.maximum(total, total[top] - switch) + s
    at, out = int(total.argmax()), [int(total.argmax())]
    for b in reversed(back):
        at = int(b[at])
        out.append(at)
    return np.array(out[::-1])


def segments_of(raws: list[str | None], net: ByteConvNet, switch: float = SWITCH) -> list[list[tuple[str, float, int, str]]]:
    """For each message its segments: (language, confidence, words, text)."""
    index: dict[str, int] = {}
    docs = []
    for raw in raws:
        docs.append([index.setdefault(s, len(index)) for p in clean_passages(raw) for s in sentences(p) if any(map(str.isalpha, s))])
    texts = list(index)
    x, owner = windows_of(texts)
    logp = np.log(net.predict(x) + 1e-6)
    total = np.zeros((len(texts), len(CLASSES)))
    np.add.at(total, owner, logp)
    mean = np.exp(total / np.maximum(np.bincount(owner, minlength=len(texts)), 1)[:, None])
    mean /= np.maximum(mean.sum(1, keepdims=True), 1e-12)
    total *= np.minimum(1, np.array([len(t) for t in texts]) / FULL_WEIGHT)[:, None]
    told = mean.max(1, initial=0) >= LEAST_SURE
    total[~told] = 0
    words = np.array([len(_WORD.findall(t)) for t in texts], int)
    size = np.array([len(t) for t in texts], float)
    out = []
    for ids in docs:
        found = []
        if ids:
            rows = np.array(ids)
            path = _path(total[rows], switch)
            cuts = np.flatnonzero(np.diff(path)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(path)]):
                own = rows[a:b]
                c = int(path[a])
                sure = np.flatnonzero(told[own])
                # sentences at either end that tell no language add no words
                inner = own[sure[0] : sure[-1] + 1] if len(sure) else own[:0]
                found.append((CLASSES[c], float(np.average(mean[own, c], weights=size[own])), int(words[inner].sum()), " ".join(texts[i] for i in own)))
        out.append(found)
    return out


def segments(docs: DataFrame, net: ByteConvNet, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", batch: int = 200, with_text: bool = True) -> DataFrame:
    """One row per segment: id, label as received, segment number, language, confidence,
    words and text.  A document without words has one row with segment_no null."""
    spark_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {spark_type}, label string, segment_no int, lang string, confidence double, n_words int, segment string"

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch]
                rows = []
                for i, label, found in zip(part["i"], part["l"], segments_of(part["t"].tolist(), net)):
                    if not found:
                        rows.append((i, label, None, None, None, 0, None))
                    rows += [(i, label, k, *s[:3], s[3] if with_text else None) for k, s in enumerate(found)]
                out = pd.DataFrame(rows, columns=["doc_id", "label", "segment_no", "lang", "confidence", "n_words", "segment"])
                out["segment_no"] = out["segment_no"].astype("Int32")
                yield out

    return docs.select(F.col(doc_id).alias("i"), F.col(lang).alias("l"), F.col(text).alias("t")).mapInPandas(apply, schema)


def documents(docs: DataFrame, net: ByteConvNet, min_words: int = 15, **columns: str) -> DataFrame:
    """One row per document: its languages (those with a segment of ``min_words`` words
    in a row, by share of words), the main one, its share and confidence, and what is
    wrong with the label: ``missing``, ``wrong``, ``mixed`` (the body has several
    languages) or ``ok``.  ``short``: no passage is long enough to tell; ``other``: one is,
    but it is in none of ``LANGUAGES`` (lang ``und``).

    Rows are made where segments are made, so nothing is shuffled."""
    doc_id, text, lang = (columns.get(k, k) for k in ("doc_id", "text", "lang"))
    spark_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {spark_type}, label string, label_lang string, lang string, confidence double, langs array<string>, lang_confidence array<double>, status string"

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), 200):
                part = frame.iloc[a : a + 200]
                rows = []
                for i, label, found in zip(part["i"], part["l"], segments_of(part["t"].tolist(), net)):
                    rows.append((i, label, *verdict(label, found, min_words)))
                yield pd.DataFrame(rows, columns=["doc_id", "label", "label_lang", "lang", "confidence", "langs", "lang_confidence", "status"])

    return docs.select(F.col(doc_id).alias("i"), F.col(lang).alias("l"), F.col(text).alias("t")).mapInPandas(apply, schema)


def verdict(label: str | None, found: list[tuple[str, float, int, str]], min_words: int, least: float = LEAST_SURE):
    """A language counts if a segment of it has ``min_words`` words and a confidence of at least ``least``."""
    named = label_language(label)
    weight: dict[str, float] = {}
    sure: dict[str, float] = {}
    for c, p, n, _ in found:
        weight[c] = weight.get(c, 0) + n
        sure[c] = sure.get(c, 0) + n * p
    enough = {c for c, p, n, _ in found if n >= min_words and p >= least}
    long = sorted(enough - {OTHER}, key=lambda c: (-weight[c], LANGUAGES.index(c)))
    main = long[0] if long else OTHER if OTHER in enough else max(weight, key=lambda c: weight[c], default=None)
    conf = [sure[c] / max(weight[c], 1) for c in long]
    status = ("other" if OTHER in enough else "short") if not long else "mixed" if len(long) > 1 else "missing" if not _names_any(label) else "ok" if named == main else "wrong"
    return named, main, (sure[main] / max(weight[main], 1)) if main else None, long, conf, status


# Labels that name no language.
NO_LANGUAGE = frozenset("- xx und auto mis zxx mul none null n/a na unknown utf-8 utf8 us-ascii ?".split())


def _names_any(label: str | None) -> bool:
    return bool(label and label.strip() and label.strip().lower() not in NO_LANGUAGE)
