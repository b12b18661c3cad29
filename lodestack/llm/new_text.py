"""Problem 1: quoted history, signatures and disclaimers in e-mails.

Method: pattern automata. What a message shows by its form (quote marks, lines that introduce quotes, forwarded headers,
separators, closing formulas) is marked first. Then an automaton is built per message from its thread: all sentences of the earlier
messages it quotes from, the closing lines of the same sender, and the closing sentences that recur through the corpus
(disclaimers). The message is scanned with it, the matched intervals are merged with the marked ones, and lines that
they cover are subtracted. Sentences of the thread and closing lines of the sender count where they continue a marked stretch, so
that two versions of one message do not erase each other.

Nothing is collected per thread or per sender: a message meets the sentences and lines it shares by joins on their hashes, the same joins
at every size. The thread of a message is what it quotes: every other text that holds a sentence it quotes as its own. So that a sentence that many quote and many hold does not
pair them all, a message is not joined with its thread: first the sentences are found that stand anywhere in its lines next to marked ones, then for each of these, once per pair of sentences, whether some
other text holds it together with one that the message quotes. The recurring closing sentences are those in at least ``LEAST_SUPPORT`` messages that begin differently. The ``NOTICES``
most frequent are broadcast; the rarer ones are found in the messages by the hashes of runs of words. Both match anywhere.

Defined results
* Null and empty texts have no lines. Lines of white space are no case. Repeated exports of a sample count once.
* A sample without a type in the export takes that of the sample table; unknown types are no e-mails. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.rolling import WORD, Spans
from lodestack.session import cut

#: differently beginning messages in which a closing sentence recurs, however many messages there are
LEAST_SUPPORT = 6
#: recurring sentences sent to every executor, the most frequent; rarer ones move to the messages that hold them
NOTICES = 5_000
#: bits, as a power of two, of the largest sieve through which runs of words go before they are joined with sentences
SIEVE = 27
#: shortest pattern of an automaton, in letters and digits
LEAST_PATTERN = 12

# fixed values: the forms of quotes, headers, signatures and disclaimers. ``.{1,n}`` stands for letters that may be garbled.
_QUOTE = re.compile(r"^[ \t]*(?:>|\||[^\W\d_a-z]{1,3}>)")
_COLON = re.compile(r"^[ \t]*:(?:[ \t>|:]|$)")
_ATTRIBUTION = re.compile(
    r"(?:\b(?:wrote|writes|said)(?: on [\d./-]+(?:,? at [\d:]+)?)?|\bschrieb(?: am [\d./-]+(?: um [\d:]+)?)?|\bschrieb (?!(?:der|die|das|ein|eine|man|es|sie|er|wir|ich) ).{3,90}|\ba .{1,6}crit(?: le [\d./-]+)?|\bescribi.{1,6}?(?: el [\d./-]+)?)\s?:\s*$"
)
_OPENS = re.compile(r"^(?:On|At|at|Le|El|Am|Um)\b.{0,12}\d")
_KEYS = re.compile(r"^\*?(?:From|Sent|Date|To|Cc|Bcc|Subject|De|Envoy.{1,6}|.{1,4}|Objet|Date|Von|Gesendet|Datum|An|Betreff|Enviado|Fecha|Para|Asunto)\s?:\*?[ \t]")
_SURE_KEYS = re.compile(r"^\*?(?:From|Sent|To|Subject|De|Objet|Von|Gesendet|An|Betreff|Enviado|Para|Asunto)\s?:\*?[ \t]")
_OPENER = re.compile(
    r"(?i)^(?:[-_*= ]{5,}|-{2,} ?.{3,60}? ?-{2,}|(?:begin|start|d.{1,6}but|inicio|comienzo|anfang|beginn)\b.{3,60}(?:message|messages|mensaje|nachricht)\b.{0,20}:)\s*$"
)
_SEPARATOR = re.compile(r"^[ \t]*(?:--|---|\*{2,4}|_{2,4}|[—–]|={2,4}|~{2,4}|[^\x00-\x7f\s¿¡]{1,8})\s*$")
_RULE = re.compile(r"^[ \t]*(?:\*{5,}|={5,}|_{5,}|-{5,}|~{5,}|#{5,}|(?:[-*=_] ){4,}[-*=_]?)[ \t]*$")
_DEVICE = re.compile(
    r"(?i)^(?:sent (?:from|with|via) |get \w+ .{0,20}for |envoy.{1,6} (?:depuis|de mon|avec) |t.{1,6}l.{1,6}chargez |(?:enviado|escrito) (?:desde|con) |typed on |written on |.{1,6}crit (?:depuis|sur) |obt.{1,6}n .{0,20}para |(?:von|mit) mein.{1,3} .{0,40}(?:gesendet|geschickt)|gesendet (?:von|mit) |unterwegs (?:getippt|geschrieben)|hol dir )"
)
_FORMULA = re.compile(
    r"(?i)^(?:(?:with )?(?:best|kind|kindest|warm|warmest)?\s?regards|(?:all the )?best(?: wishes)?|(?:many |with )?thanks(?: and best wishes| and regards| again| in advance)?|thank you|cheers|yours(?: sincerely| truly| faithfully)?|sincerely|take care"
    r"|(?:bien |tr.{1,6}s )?cordialement|bien .{1,6} (?:vous|toi)|(?:bien )?amicalement|(?:meilleures )?salutations(?: distingu.{1,12}es)?|(?:un grand )?merci(?: beaucoup| d.{1,8}avance)?|.{1,6} bient.{1,6}t|sinc.{1,6}rement|bonne journ.{1,6}e"
    r"|(?:mit )?(?:(?:freundliche|viele|beste|liebe|herzliche|sch.{1,6}ne)n? )?gr[^a-z\s]{1,10}en?|(?:lieben |viele )?gru[^a-z\s]{1,6}|(?:vielen |besten |herzlichen )?dank(?: im voraus| und (?:viele )?gr[^a-z\s]{0,2}u?[^a-z\s]{1,10}(?:en?)?)?|danke|mfg|bis bald"
    r"|(?:un )?(?:cordial )?saludo(?:s)?(?: cordial(?:es)?)?|atentamente|(?:muchas )?gracias(?: de antemano)?|un abrazo|hasta pronto)\s?[,.!]?\s*$"
)
_GREETING = re.compile(
    r"(?i)^(?:hi|hello|dear|good (?:morning|afternoon|evening)|hey|bonjour|salut|ch.{1,6}re?s?|cher|guten (?:tag|morgen|abend)|hallo|liebe[rs]?|sehr geehrte[rs]?|moin|hola|estimad[oa]s?|buen[oa]s|querid[oa]s?)\b.{0,50}[,:!]?\s*$"
)
_NOTICE = re.compile(
    r"(?i)confiden|vertraulich|privileged|r.{1,6}serv.{1,6} .{1,6} s|addressee|destinata|empf.{1,6}nger bestimmt|by mistake|par erreur|por error|irrl|liab|haftung|virus|viren|forbidden|interdit|prohibid|untersagt|monitored|printing|imprim|drucken"
)
_SENTENCE = re.compile(r"[^.!?…]+[.!?…]*")


def _words(text: str) -> str:
    return " ".join(WORD.findall(text.lower()))


def marked(text: str) -> tuple[list[str], list[bool], list[int]]:
    """The lines of a message, which of them its form shows not to be new, and which of those close it: 1 signature or formula, 2 below a rule."""
    lines = text.split("\n")
    n = len(lines)
    old, closing = [False] * n, [0] * n
    blank = [not line.strip() for line in lines]

    # a forwarded or quoted message under its headers reaches to the end
    end = n
    for i in range(n - 2):
        run = 0
        while i + run < n and _KEYS.match(lines[i + run] + " "):
            run += 1
        if run >= 3 and sum(bool(_SURE_KEYS.match(x + " ")) for x in lines[i : i + run]) >= 2:
            end = i
            at = i - 1
            while at >= 0 and blank[at]:
                at -= 1
            if at >= 0 and _OPENER.match(lines[at]):
                end = at
            break
    for i in range(end, n):
        old[i] = True

    for i in range(end):
        if _QUOTE.match(lines[i]):
            old[i] = True
        elif _ATTRIBUTION.search(lines[i]):
            old[i] = True
            # its first lines: "On <date>," may stand alone
            for back in (1, 2):
                first = i - back
                if first < 0 or blank[first] or old[first] or _GREETING.match(lines[first]):
                    break
                if _OPENS.match(lines[first]):
                    for k in range(first, i):
                        old[k] = True
                    break
    for i in range(end):
        if _COLON.match(lines[i]) and not old[i]:
            before = i > 0 and (old[i - 1] or _COLON.match(lines[i - 1]))
            after = i + 1 < end and _COLON.match(lines[i + 1])
            gap = i - 1
            while gap >= 0 and blank[gap]:
                gap -= 1
            if before or after or (gap >= 0 and old[gap] and _ATTRIBUTION.search(lines[gap])):
                old[i] = True

    i = 0
    while i < end:
        if old[i] or blank[i]:
            i += 1
            continue
        starts = _SEPARATOR.match(lines[i]) or _RULE.match(lines[i]) or (i > 0 and (blank[i - 1] or old[i - 1]) and _FORMULA.match(lines[i]))
        if starts:
            rule = bool(_RULE.match(lines[i]))
            while i < end and not blank[i] and not (old[i] and not closing[i]):
                old[i], closing[i] = True, 2 if rule else 1
                i += 1
            continue
        if _DEVICE.match(lines[i]) and len(lines[i]) < 70 and (i == 0 or blank[i - 1] or old[i - 1]):
            old[i], closing[i] = True, 1
        i += 1
    return lines, old, closing


def _tail(lines: list[str], old: list[bool]) -> int:
    """Where the last paragraph of unmarked lines begins."""
    at = len(lines) - 1
    while at >= 0 and (old[at] or not lines[at].strip()):
        at -= 1
    while at > 0 and lines[at - 1].strip() and not old[at - 1]:
        at -= 1
    return max(at, 0)


def _sentences(lines: list[str], keep: list[int]) -> list[str]:
    """Sentences of chosen lines, without quote marks, as words; those of at least ``LEAST_PATTERN`` characters."""
    text = []
    for k in keep:
        line = lines[k]
        while m := _QUOTE.match(line) or _COLON.match(line):
            line = line[m.end() :]
        text.append(line if line.strip() else ".")
    return [w for s in _SENTENCE.findall(" ".join(text)) if len(w := _words(s)) >= LEAST_PATTERN]


def _hash(*words: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(words).encode("utf-8", "surrogatepass")) - (1 << 63)


#: roles of a message's pieces: sentences of its own, quoted ones, those of its last paragraph and below rules, closing lines, lines of the last paragraph
OWN, QUOTED, LAST, CLOSING, TAIL = range(5)
_PIECES = "sample_id bigint, role int, h bigint, words string, context bigint, t bigint"


def _tail_lines(lines: list[str], own: list[int], tail: int) -> list[str]:
    return [w for k in own if k >= tail and len(w := _words(lines[k])) >= LEAST_PATTERN]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each message (sample_id, author, text, t), by their hashes.

    ``context`` is how the message begins, a greeting apart, of its last sentences; ``t`` names the text, of own, quoted and last sentences. The words
    themselves stand once, with own sentences and those last ones that are not own. Lines of a sender are hashed with the sender.
    """
    for batch in batches:
        columns: list[list] = [[] for _ in range(6)]
        for i, author, text, t in zip(*(batch.column(k).to_pylist() for k in range(4))):
            lines, old, closing = marked(text)
            own = [k for k, o in enumerate(old) if not o]
            tail = _tail(lines, old)
            ruled = [k for k, c in enumerate(closing) if c == 2]
            sentences = _sentences(lines, own)
            context = sentences[0] if sentences else ""
            first = next((lines[k] for k in own if lines[k].strip()), "")
            if len(sentences) > 1 and _GREETING.match(first) and _words(first) == context:
                context = sentences[1]
            begins, mine = _hash(context), dict.fromkeys(sentences)
            rows = [(OWN, _hash(w), w, None, t) for w in mine]
            rows += [(QUOTED, _hash(w), None, None, t) for w in dict.fromkeys(_sentences(lines, [k for k, (o, c) in enumerate(zip(old, closing)) if o and not c]))]
            last = dict.fromkeys(_sentences(lines, [k for k in own if k >= tail]) + _sentences(lines, ruled))
            rows += [(LAST, _hash(w), None if w in mine else w, begins, t) for w in last]
            if author:
                rows += [(CLOSING, _hash(author, w), None, None, None) for w in dict.fromkeys(_words(lines[k]) for k, c in enumerate(closing) if c == 1) if len(w) >= LEAST_PATTERN]
                rows += [(TAIL, _hash(author, w), None, None, None) for w in dict.fromkeys(_tail_lines(lines, own, tail))]
            columns[0] += [i] * len(rows)
            for column, values in zip(columns[1:], zip(*rows)):
                column += values
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["sample_id", "role", "h", "words", "context", "t"])


def _automaton(patterns: list[str]) -> ahocorasick.Automaton | None:
    made = ahocorasick.Automaton()
    for p in patterns:
        made.add_word(f" {p} ", len(p) + 2)
    if not len(made):
        return None
    made.make_automaton()
    return made


def _bodies(lines: list[str]) -> list[str]:
    """The words of each line, without quote marks."""
    bodies = []
    for body in lines:
        while m := _QUOTE.match(body) or _COLON.match(body):
            body = body[m.end() :]
        bodies.append(_words(body))
    return bodies


def _covered(lines: list[str], *automata: ahocorasick.Automaton | None) -> list[float]:
    """The share of each line's words that lie in merged matches of the automata, over the message as one run of words."""
    share = [0.0] * len(lines)
    if not any(automata):
        return share
    text, spans = " ", []
    for words in _bodies(lines):
        spans.append((len(text), len(text) + len(words)))
        text += words + " " if words else ""
    hit = bytearray(len(text))
    for automaton in filter(None, automata):
        for end, size in automaton.iter(text):
            hit[end - size + 2 : end] = b"\1" * (size - 2)
    for k, (a, b) in enumerate(spans):
        if b > a:
            share[k] = sum(hit[a:b]) / (b - a)
    return share


def _note(lines: list[str], old: list[bool], *notices: ahocorasick.Automaton | None) -> None:
    """Mark the lines that recurring notices cover."""
    n, notice = len(lines), _covered(lines, *notices)
    start = 0
    while start < n:
        if old[start] or not lines[start].strip():
            start += 1
            continue
        end = start
        while end < n and lines[end].strip() and not old[end]:
            end += 1
        paragraph = range(start, end)
        matched = sum(notice[k] * len(lines[k]) for k in paragraph) / max(1, sum(len(lines[k]) for k in paragraph))
        last = all(old[k] or not lines[k].strip() for k in range(end, n))
        if matched >= 0.6:
            for k in paragraph:
                old[k] = True
        elif matched > 0 or last:
            # a notice may follow the last new line without a blank one; one that does not recur shows by several of its words
            words = " ".join(lines[k] for k in paragraph)
            if last and start > 0 and not re.search(r"\d", words) and len({m.lower()[:5] for m in _NOTICE.findall(words)}) >= 2:
                for k in paragraph:
                    old[k] = True
            else:
                k = end - 1
                while k >= start and notice[k] >= 0.8:
                    old[k] = True
                    k -= 1
        start = end


def old_lines(text: str | None, thread: ahocorasick.Automaton | None, notices: ahocorasick.Automaton | None, rare: list[str] | None = None, author: str | None = None, closings: set[int] | None = None) -> list[int]:
    """Numbers (from 1) of the lines that are not new: by form, by the recurring notices and by the sentences of the thread.

    ``rare`` holds the recurring sentences of this message that are not among the notices, ``closings`` the hashes of lines that close messages of its author.
    """
    if not text:
        return []
    lines, old, closing = marked(text)
    n = len(lines)
    own = [k for k, o in enumerate(old) if not o]
    sender = _automaton([w for w in _tail_lines(lines, own, _tail(lines, old)) if _hash(author, w) in closings]) if closings and author else None
    _note(lines, old, notices, _automaton(rare) if rare else None)
    if thread or sender:
        share = _covered(lines, thread, sender)
        for order in (range(1, n), range(n - 2, -1, -1)):
            step = 1 if order.step < 0 else -1
            for k in order:
                if not old[k] and share[k] >= 0.8 and old[k + step] and not _GREETING.match(lines[k]):
                    old[k] = True
    return [k + 1 for k in range(n) if old[k] and lines[k].strip()]


def _reached(lines: list[str], old: list[bool]) -> list[bool]:
    """Which unmarked lines a marked stretch may go on into: those of paragraphs that touch one."""
    n, reached, start = len(lines), [False] * len(lines), 0
    while start < n:
        end = start
        while end < n and not old[end] and lines[end].strip():
            end += 1
        if end > start and (start > 0 and old[start - 1] or end < n and old[end]):
            reached[start:end] = [True] * (end - start)
        start = end + 1
    return reached


def _spans(words: list[str]) -> Spans:
    return Spans(np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words)))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sentences (h, words) with the hash of all their words (key) and of their first two (head), and how many words they have (n)."""
    for batch in batches:
        rows = []
        for words in batch.column(1).to_pylist():
            n = words.count(" ") + 1
            key, head = _spans(words.split(" ")).hash(np.zeros(2, np.int64), np.array([n, min(n, 2)])).view(np.int64).tolist()
            rows.append((key, head, n))
        made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["h", "words", "key", "head", "n"])


def _passes(sieve: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - bits)
    return (sieve[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _places(lines: list[str], wanted: list[bool], lengths: list[int], sieve: np.ndarray, bits: int) -> np.ndarray:
    """The hashes of those runs of words, of the given lengths, that overlap a wanted line and pass the sieve."""
    bodies = [b.split(" ") if b else [] for b in _bodies(lines)]
    words = [w for b in bodies for w in b]
    n, spans = len(words), _spans(words)
    inside = np.concatenate([[0], np.cumsum(np.repeat(wanted, [len(b) for b in bodies]))]).astype(np.int64)
    pairs = np.arange(max(0, n - 1))
    pairs = pairs[_passes(sieve, bits, spans.hash(pairs, pairs + 2))]
    kept = [np.zeros(0, np.uint64)]
    for length in lengths:
        at = np.arange(n) if length == 1 else pairs
        at = at[at + length <= n]
        at = at[inside[at + length] > inside[at]]
        keys = spans.hash(at, at + length)
        kept.append(keys[_passes(sieve, bits, keys)])
    return np.unique(np.concatenate(kept))


def _standing(texts: DataFrame, sentences: DataFrame, notices: Broadcast | None) -> DataFrame:
    """(t, h, words): the sentences (h, words) that stand, anywhere and across lines, in unmarked lines of the texts (t, text, rare).

    With ``notices`` only in those lines that a marked stretch may go on into. Runs of words meet the sentences by their hashes, in one join; a sieve of bounded size, sent to every
    task, keeps nearly all other runs from moving and loses none.
    """
    keyed = cut(sentences.mapInArrow(_keys, "h bigint, words string, key bigint, head bigint, n int"))
    lengths = sorted(r.n for r in keyed.select("n").distinct().collect())
    bits = min(SIEVE, max(10, (16 * keyed.count()).bit_length()))
    set_bits = keyed.select(F.explode(F.array("key", "head")).alias("x")).select(F.shiftrightunsigned("x", 64 - bits).alias("at"))
    words = set_bits.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    sieve = np.zeros(1 << bits - 6, np.uint64)
    sieve[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    held = texts.sparkSession.sparkContext.broadcast((lengths, sieve))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, sieve = held.value
        common = _automaton(notices.value) if notices else None
        for batch in batches:
            names, keys = [], [np.zeros(0, np.uint64)]
            for t, text, rare in zip(*(batch.column(k).to_pylist() for k in range(3))):
                lines, old, _ = marked(text)
                if notices:
                    _note(lines, old, common, _automaton(rare) if rare else None)
                wanted = _reached(lines, old) if notices else [not o for o in old]
                if any(wanted):
                    keys.append(_places(lines, wanted, lengths, sieve, bits))
                    names += [t] * len(keys[-1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.concatenate(keys).view(np.int64))], ["t", "key"])

    return texts.select("t", "text", "rare").mapInArrow(run, "t bigint, key bigint").join(keyed, "key").select("t", "h", "words")


def emails(exported: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample_id, author, text) of the exported e-mail samples."""
    rows = exported.select(F.col("sample_id").cast("bigint").alias("sample_id"), "type", "text").where("sample_id is not null and text is not null and text <> ''")
    known = samples.where("id is not null").select(
        F.col("id").cast("bigint").alias("sample_id"), F.concat_ws("/", "media", "subtype").alias("kind"), F.lower(F.trim(F.get_json_object("metadata", "$.author"))).alias("author")
    )
    joined = rows.join(known.groupBy("sample_id").agg(F.min("kind").alias("kind"), F.min("author").alias("author")), "sample_id", "left")
    kind = F.coalesce("type", "kind")
    return joined.where((kind == "text/email") | kind.startswith("text/email/")).select("sample_id", "author", "text")


def evidence(exported: DataFrame, samples: DataFrame) -> tuple[DataFrame, list[str]]:
    """Messages (sample_id, author, text, thread, rare, closings) with what of their thread and sender they are scanned for, and the notices all are scanned for."""
    messages = cut(emails(exported, samples).distinct().withColumn("t", F.xxhash64("text")))
    # sentences meet by their hashes; the words themselves move only where they are needed
    pieces = cut(messages.select("sample_id", "author", "text", "t").mapInArrow(_pieces, _PIECES))
    of = lambda *roles: pieces.where(F.col("role").isin(*roles))

    # closing sentences that recur in messages that begin differently, and nearly always where messages close; equal texts count as one
    texts = of(OWN, LAST).groupBy("h", "role", "t").agg(F.min("context").alias("context"))
    n = lambda role: F.count(F.when(F.col("role") == role, 1))
    where = texts.groupBy("h").agg(n(LAST).alias("last"), n(OWN).alias("own"), F.countDistinct(F.when(F.col("role") == LAST, F.col("context"))).alias("contexts"))
    recurring = cut(where.where((F.col("contexts") >= LEAST_SUPPORT) & (F.col("last") >= 0.8 * F.col("own"))).select("h", "last"))
    frequent = cut(recurring.orderBy(F.desc("last"), "h").limit(NOTICES).select("h"))
    worded = of(OWN, LAST).where("words is not null").select("h", "words")
    notices = [r.words for r in worded.join(F.broadcast(frequent), "h").groupBy("h").agg(F.min("words").alias("words")).toLocalIterator()]
    rest = recurring.join(F.broadcast(frequent), "h", "left_anti").select("h")
    known = messages.groupBy("t").agg(F.min("text").alias("text"))
    rare = messages.select("t", F.lit(None).cast("array<string>").alias("rare")).limit(0)
    if rest.take(1):
        all_rare = worded.join(rest, "h").groupBy("h").agg(F.min("words").alias("words"))
        rare = cut(_standing(known.withColumn("rare", F.lit(None).cast("array<string>")), all_rare, None).groupBy("t").agg(F.collect_set("words").alias("rare")))

    # the thread of a message: the other texts that hold a sentence it quotes. Equal texts count as one, and a text is no thread of its own
    other = (F.col("low") != F.col("t")) | (F.col("high") != F.col("t"))
    held = of(OWN).groupBy("h").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    asked = cut(of(QUOTED).select("t", "h").distinct().join(held, "h").where(other).select("t", F.col("h").alias("quoted")))
    thread = messages.select("t", F.lit(None).cast("array<string>").alias("thread")).limit(0)
    if asked.take(1):
        sources = of(OWN).join(asked.select(F.col("quoted").alias("h")), "h", "left_semi").select("t").distinct()
        owned = cut(of(OWN).join(sources, "t", "left_semi").groupBy("h", "t").agg(F.min("words").alias("words")))
        asking = known.join(asked, "t", "left_semi").join(rare, "t", "left")
        standing = cut(_standing(asking, owned.groupBy("h").agg(F.min("words").alias("words")), messages.sparkSession.sparkContext.broadcast(notices)))
        # whether a sentence stands in a text together with a quoted one is asked once per pair of them, of the holders of the rarer one
        both = cut(standing.select("t", F.col("h").alias("stands")).join(asked, "t"))
        many = owned.groupBy("h").count()
        pairs = both.select("quoted", "stands").distinct()
        pairs = pairs.join(many.select(F.col("h").alias("quoted"), F.col("count").alias("x")), "quoted").join(many.select(F.col("h").alias("stands"), F.col("count").alias("y")), "stands")
        first = F.col("x") <= F.col("y")
        pairs = pairs.select("quoted", "stands", F.when(first, F.col("quoted")).otherwise(F.col("stands")).alias("h"), F.when(first, F.col("stands")).otherwise(F.col("quoted")).alias("with"))
        holders = pairs.join(owned.select("h", "t"), "h").select("quoted", "stands", F.col("with").alias("h"), "t")
        meet = holders.join(owned.select("h", "t"), ["h", "t"]).groupBy("quoted", "stands").agg(F.min("t").alias("low"), F.max("t").alias("high"))
        shown = both.join(meet, ["quoted", "stands"]).where(other).select("t", F.col("stands").alias("h")).distinct()
        thread = standing.join(shown, ["t", "h"]).groupBy("t").agg(F.collect_set("words").alias("thread"))
    # closing lines of the same sender
    closings = of(TAIL).select("sample_id", "h").join(of(CLOSING).select("h").distinct(), "h", "left_semi")
    closings = closings.groupBy("sample_id").agg(F.collect_set("h").alias("closings"))
    joined = messages.join(thread, "t", "left").join(rare, "t", "left").join(closings, "sample_id", "left")
    return joined.select("sample_id", "author", "text", "thread", "rare", "closings"), notices


def found(exported: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample_id, line_no) of every line with a character other than white space that its sender did not newly write."""
    messages, notices = evidence(exported, samples)
    held = messages.sparkSession.sparkContext.broadcast(notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = _automaton(held.value)
        built: tuple[list, ahocorasick.Automaton | None] = ([], None)
        for batch in batches:
            rows = []
            for i, author, text, patterns, few, ends in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if patterns and patterns != built[0]:
                    built = patterns, _automaton(patterns)
                rows += [(i, k) for k in old_lines(text, built[1] if patterns else None, common, few, author, set(ends or ()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["sample_id", "line_no"])

    return messages.mapInArrow(run, "sample_id bigint, line_no bigint").distinct()


def reduced(exported: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample_id, text): each e-mail with only the lines its sender newly wrote, runs of blank lines and blank ends taken off."""
    messages = emails(exported, samples).dropDuplicates(["sample_id"])
    old = found(exported, samples).groupBy("sample_id").agg(F.collect_set("line_no").alias("old"))
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda line, k: ~F.array_contains(F.coalesce("old", F.array().cast("array<bigint>")), (k + 1).cast("bigint")))
    joined = F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\n\s*\n(\s*\n)+", "\n\n"), r"^\s+|\s+$", "")
    return messages.join(old, "sample_id", "left").select("sample_id", joined.alias("text"))
