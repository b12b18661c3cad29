"""Problem 2: garbled text from wrong character encoding.

Method: a multinomial classifier on hashed byte bigrams, trained on records garbled by every known chain of a right and a wrong
encoding, scores each word with a character beyond ASCII. The stretch of a text that one chain explains best against "not garbled" is undone by
inverting that chain, which must decode strictly; that is repeated until no stretch is left, so parts and repeated
garbling are found too.

Defined results
* Null and empty texts are not garbled. Texts that hold U+FFFD are garbled and lost: their restored checksum is empty.
* Characters that no chain explains better than ordinary text does are meant and stay.
* Repeated rows of a sample count once; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows that the classifier is fitted on: the first by a hash of their id
TRAIN = 4000
BUCKETS = 1 << 14
#: log odds that a stretch must overcome, about those of a garbled text among others
PRIOR = 4.0
#: the same for chains that are rarely met: a single-byte encoding read as another that is not a DOS code page
RARE_PRIOR = 8.0
#: the same for a further stretch of a text in which that chain was undone already
AGAIN = 0.5
_BROKEN = -12.0

LOST = "�"
_TOKEN = re.compile(r"[^ \t\r\n]*[^\x00-\x7f \t\r\n][^ \t\r\n]*")
_LETTER = re.compile("[A-Za-z]")
_OTHER = re.compile("[^\\x00-\u017f\u2010-\u2122\u2190-\u2bff]")
_RUN = re.compile(r"[^\x00-\x7f]+")


def _table(codec: str) -> list[str]:
    """The character of every byte; a byte without one stands for itself."""
    return [bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256)]


class Step:
    """Bytes of one encoding read as another of single bytes."""

    def __init__(self, right: str, wrong: str) -> None:
        self.right = right
        self.chars = _table(wrong)
        self.bytes = {c: b for b, c in enumerate(self.chars)}
        if wrong == "cp1252":  # readers differ on its five open places and on C1, and all of it can be told apart
            self.bytes |= {chr(b): b for b in range(0x80, 0xA0)} | {c: b for b, c in enumerate(self.chars) if b >= 0x80}
        if right != "utf-8":
            self.right_chars = _table(right)
            self.right_bytes = {c: b for b, c in enumerate(self.right_chars)}

    def garble(self, text: str) -> str | None:
        if self.right == "utf-8":
            raw = text.encode("utf-8", "surrogatepass")
        else:
            found = [self.right_bytes.get(c) for c in text]
            if None in found:
                return None
            raw = bytes(found)
        return "".join(self.chars[b] for b in raw)

    def undo(self, run: str) -> str | None:
        found = [self.bytes.get(c) for c in run]
        if None in found:
            return None
        raw = bytes(found)
        if self.right != "utf-8":
            return "".join(self.right_chars[b] for b in raw)
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return None


_U = {w: Step("utf-8", w) for w in ("latin-1", "cp1252", "mac_roman", "cp1250", "cp1251", "cp437", "cp850")}
#: fixed values: the chains, each as its steps in the order in which they garbled
CHAINS: dict[str, tuple[Step, ...]] = {
    "utf-8 as cp1252": (_U["cp1252"],),
    "utf-8 as latin-1": (_U["latin-1"],),
    "utf-8 as cp1252 twice": (_U["cp1252"], _U["cp1252"]),
    "utf-8 as latin-1 twice": (_U["latin-1"], _U["latin-1"]),
    "utf-8 as mac_roman": (_U["mac_roman"],),
    "utf-8 as cp1250": (_U["cp1250"],),
    "utf-8 as cp1251": (_U["cp1251"],),
    "utf-8 as cp437": (_U["cp437"],),
    "utf-8 as cp850": (_U["cp850"],),
    "cp1252 as cp437": (Step("cp1252", "cp437"),),
    "cp1252 as cp850": (Step("cp1252", "cp850"),),
    "cp1252 as mac_roman": (Step("cp1252", "mac_roman"),),
    "cp1252 as cp1251": (Step("cp1252", "cp1251"),),
    "mac_roman as cp1252": (Step("mac_roman", "cp1252"),),
}
RARE = {"cp1252 as mac_roman", "cp1252 as cp1251", "mac_roman as cp1252"}
for _name in ("utf-8 as latin-1", "utf-8 as latin-1 twice"):
    for _step in CHAINS[_name]:
        _step.bytes |= _U["cp1252"].bytes


def garble(text: str, chain: str) -> str | None:
    """The text as the chain garbles it; None where the chain cannot hold its characters."""
    for step in CHAINS[chain]:
        text = step.garble(text) if text is not None else None
    return text


def undo(token: str, chain: str) -> str | None:
    """The token with every run beyond ASCII taken back through the chain; None unless all of them decode strictly."""
    for step in reversed(CHAINS[chain]):
        parts, at = [], 0
        for m in _RUN.finditer(token):
            back = step.undo(m.group())
            if back is None:
                return None
            parts += [token[at : m.start()], back]
            at = m.end()
        token = "".join(parts) + token[at:]
    return token


def _features(token: str) -> np.ndarray:
    raw = np.frombuffer(b"\2" + token.encode("utf-8", "surrogatepass") + b"\3", np.uint8).astype(np.int64)
    a, b = raw[:-1], raw[1:]
    beyond = (a >= 0x80) | (b >= 0x80)
    return (a[beyond] * 1009 + b[beyond] * 31) % BUCKETS


def _bytes(token: str) -> np.ndarray:
    return np.frombuffer(b"\2" + token.encode("utf-8", "surrogatepass") + b"\3", np.uint8).astype(np.int64)


class Classifier:
    """Scores of a word under every chain.

    ``odds``: log P(bigram | chain) - log P(bigram | not garbled) of hashed byte bigrams, a row per chain. ``follow``: log P(byte | byte before) in words that
    are not garbled; as a chain only renames characters, what it undoes must read better than what stood there. A word
    speaks for a chain as far as both do. ``shares``: log shares of whole words, which
    stand for what their bytes tell where they are larger, and alone for words without a Latin letter.
    """

    def __init__(self, odds: np.ndarray, follow: np.ndarray, shares: dict[str, float]) -> None:
        self.odds, self.follow, self.shares = odds, follow, shares
        self._known: dict[str, list[tuple[float, str | None]]] = {}

    @classmethod
    def fit(cls, texts: list[str]) -> Classifier:
        words: dict[str, float] = Counter()
        for text in texts:
            tokens = _TOKEN.findall(text)
            # texts that already hold decodable garbling would teach the wrong class
            if LOST not in text and not any(_decodable(t) for t in tokens):
                words.update(tokens)
        # a word may also come in capitals, though that is rarely seen
        for token, n in list(words.items()):
            if (high := token.upper()) != token:
                words[high] = max(words[high], 0.05 * n)
        counts = np.zeros((len(CHAINS) + 1, BUCKETS))
        pairs = np.full((256, 256), 0.01)
        for token, n in words.items():
            np.add.at(counts[0], _features(token), n)
            raw = _bytes(token)
            np.add.at(pairs, (raw[:-1], raw[1:]), n)
            for k, chain in enumerate(CHAINS, 1):
                bad = garble(token, chain)
                if bad is not None and bad != token:
                    np.add.at(counts[k], _features(bad), n)
        smooth = counts + 0.02
        logs = np.log(smooth / smooth.sum(axis=1, keepdims=True))
        total = sum(words.values()) + 1
        shares = {t: math.log((n + 0.1) / total) for t, n in words.items()} | {"": math.log(0.1 / total)}
        return cls((logs[1:] - logs[0]).astype(np.float32), np.log(pairs / pairs.sum(axis=1, keepdims=True)).astype(np.float32), shares)

    def _reads(self, token: str) -> float:
        share = self.shares.get(token)
        if not _LETTER.search(token):
            return self.shares[""] if share is None else share
        raw = _bytes(token)
        by_bytes = float(self.follow[raw[:-1], raw[1:]].sum())
        return by_bytes if share is None else max(by_bytes, share)

    def scores(self, token: str) -> list[tuple[float, str | None]]:
        """For every chain what the word adds for it, and the word with the chain undone (None if it does not decode)."""
        if (known := self._known.get(token)) is not None:
            return known
        if len(self._known) > 200_000:
            self._known.clear()
        features, reads, made = _features(token), self._reads(token), []
        for k, chain in enumerate(CHAINS):
            back = undo(token, chain)
            made.append((_BROKEN, None) if back is None else (min(float(self.odds[k][features].sum()), self._reads(back) - reads), back))
        self._known[token] = made
        return made

    def restore(self, text: str | None) -> tuple[str | None, list[str]]:
        """The restored text, and the chains that were undone in it."""
        undone: list[str] = []
        while text and len(undone) < len(text):
            tokens = list(_TOKEN.finditer(text))
            scores = [self.scores(t.group()) for t in tokens]
            best = (0.0, -1, 0, 0)
            for k, chain in enumerate(CHAINS):
                prior = AGAIN if chain in undone else RARE_PRIOR if chain in RARE else PRIOR
                # the stretch of words with the largest sum
                total, start = 0.0, 0
                for n, s in enumerate(scores):
                    if total <= 0:
                        total, start = 0.0, n
                    total += s[k][0]
                    if total - prior > best[0] + 1e-6:
                        best = (total - prior, k, start, n)
            _, k, start, end = best
            if k < 0:
                break
            parts, at, steps = [], 0, CHAINS[list(CHAINS)[k]]
            for n in range(start, end + 1):
                gain, back = scores[n][k]
                # between garbled words a word that reads well as it stands was not garbled; what decodes as UTF-8 is no accident
                if back is not None and (gain > 0 or steps[-1].right == "utf-8"):
                    parts += [text[at : tokens[n].start()], back]
                    at = tokens[n].end()
            text = "".join(parts) + text[at:]
            undone.append(list(CHAINS)[k])
        return text, undone


def _decodable(token: str) -> bool:
    """Whether some UTF-8 chain decodes the word to Latin letters and signs; other scripts come of it by chance ("’é")."""
    for chain, steps in CHAINS.items():
        back = undo(token, chain) if steps[0].right == "utf-8" else None
        if back is not None and not _OTHER.search(back):
            return True
    return False


def train(samples: DataFrame, rows: int = TRAIN) -> Classifier:
    """Fit on at most ``rows`` texts, those of the least hashes of their ids.

    The hash bound is set by the number of rows, so that about twice as many reach the driver, from however many partitions.
    """
    some = samples.where("text is not null and text <> '' and sample_id is not null").withColumn("h", F.pmod(F.xxhash64("sample_id"), F.lit(1 << 30)))
    bound = int(min(1.0, 2 * rows / max(1, some.count())) * (1 << 30))
    drawn = some.where(F.col("h") <= bound).select("h", "sample_id", "text").collect()
    return Classifier.fit([r.text for r in sorted(drawn)[:rows]])


def restored(samples: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """(sample_id, text, chains, restored_checksum) of garbled samples; text is null and the checksum empty where characters are lost."""
    fitted = samples.sparkSession.sparkContext.broadcast(classifier or train(samples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if LOST in text:
                    rows.append((i, None, "lost", ""))
                    continue
                good, chains = fitted.value.restore(text)
                if chains:
                    rows.append((i, good, ", ".join(chains), hashlib.sha256(good.encode("utf-8", "surrogatepass")).hexdigest()))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in enumerate(kinds)], ["sample_id", "text", "chains", "restored_checksum"])

    # only texts beyond ASCII leave the JVM
    texts = samples.select(F.col("sample_id").cast("bigint").alias("sample_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where(F.col("sample_id").isNotNull() & (F.octet_length("text") > F.char_length("text")))
    return texts.mapInArrow(run, "sample_id bigint, text string, chains string, restored_checksum string")


def found(samples: DataFrame) -> DataFrame:
    """(sample_id, restored_checksum) of the garbled samples."""
    return restored(samples).select("sample_id", "restored_checksum").distinct()
