"""Text decoded with the wrong character encoding: find it and restore the original.

One pass counts, over all documents, in how many each adjacent pair of characters occurs. The pair's
score is its pointwise mutual information, shrunk towards a penalty where the pair is rare. In each
document the runs of improbable pairs are isolated as all maximal scoring segments of the negated score,
and only inside those runs are inverse mappings tested: encode with the encoding wrongly used, decode
with the one meant. A mapping holds if it decodes and makes the characters more probable; this is done
again until nothing changes. Replacement characters have no vote, so those beside letters lie in such runs too.

The counts live in a table of fixed size (hashed pairs), so what is collected and broadcast is bounded.

A source decoded wrongly as a whole makes its own garbled pairs common. So runs that look garbled by their
structure are not counted, and where a text has enough valid UTF-8 sequences, these alone are evidence.

Some encodings show other scripts as plain ASCII when their name is not known: those that shift by escapes or
brackets, and those of two or four bytes a character, whose high bytes are controls. So texts of ASCII are
counted and searched as all others are.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR_BITS, CHAR_BITS = 18, 15
#: A pair in this share of the documents with characters beyond ASCII counts as established.
ESTABLISHED = 0.05
#: Score of a pair never seen, and of a pair of two ASCII characters.
PENALTY, PLAIN = -4.0, 0.75
#: Mean gain in log count a pair that a mapping between two single-byte encodings must bring.
SINGLE_BYTE_GAIN = 2.0
#: UTF-8 continuation bytes that are evidence by themselves, and the share of the legible runs that a text's encoding must explain.
EVIDENT, EXPLAINED = 4, 0.75
#: Net number of characters in two bytes each, with a control as the high one, and of letters of a small script, that are evidence by themselves.
EVIDENT_LETTERS = 4
REMEMBERED = 200_000

# Encodings that text is wrongly read with, and the single-byte ones it is written in.
WRONG = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8-r", "cp866", "cp1254", "iso8859-15", "iso8859-2", "mac_cyrillic", "cp1253", "cp852")
MEANT = ("cp1251", "koi8-r", "cp866", "cp1250", "iso8859-2", "cp1252", "mac_roman", "mac_cyrillic", "cp437", "cp850", "shift_jis", "euc_jp", "gb18030", "big5", "euc_kr")

NON_ASCII = re.compile(r"[^\x00-\x7f]+")
RUN = re.compile(r"[^\x00-\x7f]{2,}")
_LATIN = re.compile(r"[\u0080-\u017f\u2010-\u203a\u20ac\u2122]+")
_ACCENTED = re.compile(r"[\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+")
LOST = "\ufffd"
_LETTER_BESIDE_LOST = re.compile(r"[^\W\d_]�|�[^\W\d_]")

CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f]")
_ESCAPED = re.compile(r"(\x1b(?:\$(?:[@AB]|\([CDOPQ])|\(I))([!-~]+)(?:\x1b\([BJ])?")
_SHIFTED = re.compile(r"\x0e((?:[!-~]{2}|[ \t\r\n])+)\x0f")
_DESIGNATED = re.compile(r"\x1b\$\)([AC])")
_BRACED = re.compile(r"~\{((?:[!-}][!-~])+?)~\}")
_BASE64 = re.compile(r"\+[A-Za-z0-9+/]{3,}-?")
_ESCAPING = ("iso2022_jp_ext", "iso2022_jp_2", "iso2022_jp_3")


def _with_controls(name: str) -> dict[int, int]:
    """Character code to byte of an encoding whose undefined bytes stand for the control of the same number."""
    table = {}
    for byte in range(256):
        try:
            table[ord(bytes([byte]).decode(name))] = byte
        except UnicodeDecodeError:
            table.setdefault(byte, byte)
    if name == "cp1252":
        for byte in range(0x80, 0xA0):
            table.setdefault(byte, byte)
    return table


_BYTES = {name: _with_controls(name) for name in WRONG}


def unread(run: str, wrong: str) -> bytes | None:
    """The bytes that the wrong encoding showed as ``run``."""
    table = _BYTES[wrong]
    try:
        return bytes([table[ord(c)] for c in run])
    except KeyError:
        return None


def pair_bins(codes: np.ndarray) -> np.ndarray:
    left, right = codes[:-1].astype(np.uint64), codes[1:].astype(np.uint64)
    mixed = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - PAIR_BITS)


def char_bins(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CHAR_BITS)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def _shown_utf8(run: str) -> tuple[tuple[str, str], ...]:
    """(wrong encoding, reading) for each way to read the whole of ``run`` as UTF-8, once."""
    return tuple((wrong, text) for text, wrong in _read_once(run))


_shown_short = functools.lru_cache(maxsize=REMEMBERED)(_shown_utf8)


def _shown(run: str) -> tuple[tuple[str, str], ...]:
    return _shown_short(run) if len(run) < 40 else _shown_utf8(run)


def _script(c: str) -> str:
    name = unicodedata.name(c, "").split(" ")[0].split("-")[0]
    return "CJK" if name in ("HIRAGANA", "KATAKANA", "IDEOGRAPHIC", "FULLWIDTH", "HALFWIDTH") else name


def _telling(run: str, text: str) -> bool:
    """Whether the reading of a run speaks for itself: Latin letters and their punctuation, or several sequences that are a word of one script."""
    if _LATIN.fullmatch(text):
        return True
    if len(run) - len(text) < 3:
        return False
    letters = [c for c in text if unicodedata.category(c)[0] in "LM"]
    rest = (c for c in text if unicodedata.category(c)[0] not in "LMPZ")
    return len({_script(c) for c in letters}) < 2 and all(ord(c) >= 0x1F000 for c in rest)


def _suspect(run: str) -> bool:
    """Whether ``run`` looks garbled by its structure: such runs have no vote on what is probable."""
    return len(run) > 1 and (len(run) > 3 and _ACCENTED.fullmatch(run) is not None or any(_telling(run, text) for _, text in _shown(run)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs, chars, documents, beyond = np.zeros(1 << PAIR_BITS, np.int64), np.zeros(1 << CHAR_BITS, np.int64), 0, 0
    for batch in batches:
        for text in batch["text"].to_pylist():
            codes = _codes(text)
            pair_votes, char_votes = np.ones(len(codes) - 1, bool), np.ones(len(codes), bool)
            for m in NON_ASCII.finditer(text):
                if _suspect(m.group()) or LOST in m.group():
                    pair_votes[m.start() : m.end() + 1] = False
                    char_votes[m.start() + 1 : m.end() + 1] = False
            pairs[np.unique(pair_bins(codes)[pair_votes])] += 1
            chars[np.unique(char_bins(codes)[char_votes])] += 1
            documents += 1
            beyond += not text.isascii()
    for kind, counts in ((0, pairs), (1, chars), (2, np.array([documents])), (3, np.array([beyond]))):
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(counts[at])], ["kind", "bin", "n"])


class PairModel:
    """Corpus counts of character pairs and what follows from them; ``beyond`` documents have characters beyond ASCII."""

    def __init__(self, pairs: np.ndarray, chars: np.ndarray, documents: int, beyond: int | None = None):
        self.pairs, self.chars, self.documents = pairs, chars, max(1, documents)
        self.beyond = self.documents if beyond is None else max(1, beyond)
        self.known: dict = {}
        self.logs: dict[str, float] = {}
        self.log_share = np.log((pairs + 0.1) / self.documents)
        self.best_log = float(self.log_share.max())

    def remembered(self, key: tuple, make):
        """``make()``, computed once a worker for each of the first ``REMEMBERED`` keys: words repeat."""
        if key in self.known:
            return self.known[key]
        value = make()
        if len(self.known) < REMEMBERED and sum(map(len, key)) < 80:
            self.known[key] = value
        return value

    def scores(self, codes: np.ndarray) -> np.ndarray:
        joint = self.pairs[pair_bins(codes)].astype(float)
        single = np.maximum(self.chars[char_bins(codes)].astype(float), 1)
        information = np.log(np.maximum(joint, 0.5) * self.documents / (single[:-1] * single[1:]))
        weight = joint / (joint + ESTABLISHED * self.beyond)
        score = weight * np.maximum(information, 0.1) + (1 - weight) * PENALTY
        plain = (codes[:-1] < 128) & (codes[1:] < 128)
        return np.where(plain, PLAIN, score)

    def pair_log(self, pair: str) -> float:
        """The log share of documents of one adjacent pair."""
        value = self.logs.get(pair)
        if value is None:
            value = float(self.log_share[int(pair_bins(np.frombuffer(pair.encode("utf-32-le", "surrogatepass"), np.uint32))[0])])
            if len(self.logs) < 4 * REMEMBERED:
                self.logs[pair] = value
        return value

    def knows(self, text: str) -> bool:
        """Whether the corpus has every character of ``text``."""
        return bool((self.chars[char_bins(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))] > 0).all())

    def likelihood(self, text: str) -> float:
        """The mean log share of documents of the adjacent pairs."""
        if len(text) < 2:
            return 0.0
        if len(text) > 40:
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            return float(self.log_share[pair_bins(codes)].sum()) / (len(codes) - 1)
        known, total = self.logs, 0.0
        for k in range(len(text) - 1):
            pair = text[k : k + 2]
            value = known.get(pair)
            total += self.pair_log(pair) if value is None else value
        return total / (len(text) - 1)


def maximal_segments(values: np.ndarray) -> list[tuple[int, int]]:
    """All maximal scoring segments [start, end) of a sequence, in linear time (Ruzzo and Tompa).

    Of the segments found none can be made to score more by lengthening or shortening it, and no two of them touch.
    Neighbours of one sign are taken together first, which changes no segment but for zeros at its ends.
    """
    positive = values > 0
    if not positive.any():
        return []
    edges = np.flatnonzero(np.diff(positive)) + 1
    bounds = np.concatenate([[0], edges, [len(values)]])
    sums = np.add.reduceat(values, bounds[:-1])
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum with it, the last one whose sum before is less
    total = 0.0
    for k in range(0 if positive[0] else 1, len(sums), 2):
        before = total + (float(sums[k - 1]) if k else 0.0)
        total = before + float(sums[k])
        start, end = int(bounds[k]), int(bounds[k + 1])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append((start, end, before, total, j))
                break
            start, before = found[j][0], found[j][2]
            del found[j:]
    return [(start, end) for start, end, _, _, _ in found]


def _widened(text: str, start: int, end: int) -> tuple[int, int]:
    while start > 0 and not text[start - 1].isspace():
        start -= 1
    while end < len(text) and not text[end].isspace():
        end += 1
    return start, end


def _read_once(run: str) -> Iterator[tuple[str, str]]:
    """(text, wrong encoding) for each way to read ``run`` as UTF-8 shown in a wrong encoding."""
    for wrong in WRONG:
        raw = unread(run, wrong)
        if raw is None:
            continue
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if len(text) < len(run) and not any(0xE000 <= ord(c) <= 0xF8FF for c in text):
            yield text, wrong


def _readings(run: str) -> Iterator[tuple[str, str]]:
    """As ``_read_once``, any number of times over (a reading is shorter than what is read, so it ends), each text once."""
    seen, todo = {run}, [(run, None)]
    while todo:
        shown, outer = todo.pop()
        for text, wrong in _read_once(shown):
            if text not in seen:
                seen.add(text)
                yield text, outer or wrong
                if len(text) > 1 and not text.isascii():
                    todo.append((text, outer or wrong))


def _utf8_repair(run: str, left: str, right: str, model: PairModel) -> tuple[str, str] | None:
    """The most probable reading of ``run`` as UTF-8 shown in a wrong encoding, with that encoding's name."""
    before = model.likelihood(left + run + right)
    best = None
    for text, wrong in _readings(run):
        gain = model.likelihood(left + text + right) - before
        if gain > 0 and (best is None or gain > best[0]):
            best = (gain, text, wrong)
    return best and best[1:]


def _known_repair(run: str, held: list[str], model: PairModel) -> tuple[str, str] | None:
    """A reading by a mapping that held elsewhere in the text: whole, and of characters the corpus knows."""
    for wrong in held:
        raw = unread(run, wrong)
        try:
            text = raw.decode("utf-8")
        except (AttributeError, UnicodeDecodeError):
            continue
        if len(text) < len(run) and model.knows(text):
            return text, wrong
    return None


def _partial_repair(run: str, left: str, right: str, model: PairModel) -> tuple[str, str] | None:
    """As ``_utf8_repair`` for runs in which characters were lost or others stand beside garbled ones."""
    before = model.likelihood(left + run + right)
    best = None
    for wrong in WRONG:
        table = _BYTES[wrong]
        out, at, good, lost = [], 0, 0, 0
        while at < len(run):
            lead = table.get(ord(run[at]), 0)
            size = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
            raw = unread(run[at : at + size], wrong) if size else None
            try:
                out.append(raw.decode("utf-8"))
                good, at = good + size, at + size
            except (AttributeError, UnicodeDecodeError):
                out.append(run[at])
                lost, at = lost + 1, at + 1
        text = "".join(out)
        gain = model.likelihood(left + text + right) - before
        if good >= 2 and gain > 0.5 and (best is None or gain > best[0]):
            best = (gain, text, wrong)
    return best and best[1:]


def _single_byte_repair(words: str, model: PairModel) -> tuple[str, str] | None:
    """A reading of ``words`` in another encoding that makes it far more probable."""
    before = model.likelihood(words)
    # No text is likelier than one whose pairs are in all documents.
    if model.best_log - before < SINGLE_BYTE_GAIN:
        return None
    best = None
    parts = re.split(r"([^\x00-\x7f]+)", words)
    for wrong in WRONG:
        raws = [part.encode("ascii") if part.isascii() else unread(part, wrong) for part in parts]
        if None in raws:
            continue
        raw = b"".join(raws)
        for meant in MEANT:
            if meant == wrong:
                continue
            try:
                text = raw.decode(meant)
            except UnicodeDecodeError:
                continue
            if text == words:
                continue
            gain = model.likelihood(text) - before
            if gain >= SINGLE_BYTE_GAIN and (best is None or gain > best[0]):
                best = (gain, text, f"{wrong}>{meant}")
    return best and best[1:]


def _evident_repair(text: str) -> tuple[str, list[str]]:
    """``text`` with the runs read that are UTF-8 by the evidence of the text alone, and the encodings they were shown in.

    That is every run under an encoding that explains ``EXPLAINED`` of the runs it could have shown, by two or more
    different readings with ``EVIDENT`` continuation bytes together, or by one with twice as many.
    """
    runs = Counter(r for r in NON_ASCII.findall(text) if len(r) > 1)
    fits, weight, longest, told = Counter(), Counter(), Counter(), {}
    for run, n in runs.items():
        for wrong, reading in _shown(run):
            fits[wrong] += n
            if _telling(run, reading):
                weight[wrong] += n * (len(run) - len(reading))
                longest[wrong] = max(longest[wrong], len(run) - len(reading))
                told.setdefault(wrong, set()).add(reading)
    sure = [w for w in WRONG if weight[w] >= EVIDENT and (len(told[w]) > 1 or longest[w] >= 2 * EVIDENT) and fits[w] >= EXPLAINED * sum(n for r, n in runs.items() if unread(r, w) is not None)]
    if not sure:
        return text, []
    sure.sort(key=lambda w: -weight[w])
    applied: list[str] = []

    def fixed(match: re.Match) -> str:
        run = match.group()
        shown = dict(_shown(run)) if len(run) > 1 else {}
        for wrong in sure:
            if wrong in shown:
                applied.append(wrong)
                return shown[wrong]
        return run

    return NON_ASCII.sub(fixed, text), applied


def _decoded(raw: bytes, encoding: str) -> str | None:
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        return None


def _readable(text: str | None) -> bool:
    """Whether ``text`` has assigned characters only, no controls but those a further round may read, and letters of one script beside Latin."""
    if not text:
        return False
    kinds = {c: unicodedata.category(c) for c in set(text)}
    scripts = {_script(c) for c, kind in kinds.items() if kind[0] == "L"}
    return all(kind not in ("Cc", "Cn", "Co", "Cs") or c in "\t\n\f\r" or "\x80" <= c < "\xa0" for c, kind in kinds.items()) and len(scripts - {"LATIN"}) < 2


def _letters_of_small_scripts(text: str) -> int:
    """Letters beyond ASCII, but for those of which there are so many that any bytes show some."""
    return sum(ord(c) > 127 and unicodedata.category(c)[0] == "L" and unicodedata.name(c, "CJK").split(" ")[0] not in ("CJK", "HANGUL") for c in text)


def _gain(text: str, start: int, end: int, reading: str, model: PairModel) -> float:
    """What the mean log count gains where ``reading`` stands in place of ``text[start:end]``."""
    left, right = text[max(0, start - 1) : start] or " ", text[end : end + 1] or " "
    return model.likelihood(left + reading + right) - model.likelihood(left + text[start:end] + right)


def _escaped_repair(text: str, applied: list[str]) -> str:
    """``text`` with the stretches read that an escape begins, byte pairs that mean nothing as lost characters."""

    def fixed(match: re.Match) -> str:
        begin, body = match.group(1), match.group(2)
        back = re.match(r"(?:[!-~]{2})*?(?=\([BJ])", body)
        for part, rest in ((body, ""), *([(back.group(), body[back.end() + 2 :])] if back and not match.group().endswith(("\x1b(B", "\x1b(J")) else [])):
            for encoding in _ESCAPING:
                reading = _decoded(f"{begin}{part}\x1b(B".encode("ascii"), encoding)
                if _readable(reading):
                    applied.append(f"ascii>{encoding}")
                    return reading + rest
        for encoding in _ESCAPING:
            found = [_decoded(f"{begin}{body[k : k + 2]}\x1b(B".encode("ascii"), encoding) for k in range(0, len(body) - 1, 2)]
            if any(found):
                applied.append(f"ascii>{encoding}")
                return "".join(c or LOST for c in found) + LOST * (len(body) % 2)
        return match.group()

    return _ESCAPED.sub(fixed, text)


def _unescaped_repair(text: str, model: PairModel, applied: list[str]) -> str:
    """As ``_escaped_repair`` where the escape characters themselves were lost: by kana, or by what is probable."""
    out, done, last = [], 0, 0
    for match in re.finditer(r"\([BJ]", text):
        begin = match.start()
        while begin > last and "!" <= text[begin - 1] <= "~":
            begin -= 1
        start = re.search(r"\$[@B]", text[begin : match.start()])
        last = match.end()
        if not start:
            continue
        begin += start.start()
        reading = _decoded(f"\x1b{text[begin : match.start()]}\x1b(B".encode("ascii"), "iso2022_jp")
        if _readable(reading) and (_letters_of_small_scripts(reading) >= EVIDENT_LETTERS or _gain(text, begin, match.end(), reading, model) >= SINGLE_BYTE_GAIN):
            out += [text[done:begin], reading]
            done = match.end()
            applied.append("ascii>iso2022_jp")
    return "".join([*out, text[done:]])


def _shifted_repair(text: str, model: PairModel, applied: list[str]) -> str:
    """``text`` with the stretches between shift-out and shift-in read, and those between the brackets of HZ."""
    named = {{"A": "gb2312", "C": "euc_kr"}[x] for x in _DESIGNATED.findall(text)} or {"gb2312", "euc_kr"}

    def high(body: str, encoding: str) -> str | None:
        return _decoded(bytes(ord(c) | 0x80 if c > " " else ord(c) for c in body), encoding)

    def shifted(match: re.Match) -> str:
        readings = [(_gain(text, *match.span(), reading, model), reading, encoding) for encoding in sorted(named) if _readable(reading := high(match.group(1), encoding))]
        if not readings:
            return match.group()
        applied.append(f"ascii>{max(readings)[2]}")
        return max(readings)[1]

    def braced(match: re.Match) -> str:
        reading = high(match.group(1), "gb2312")
        sure = _readable(reading) and ("~" not in match.group(1) and len(reading) >= EVIDENT_LETTERS or _gain(text, *match.span(), reading, model) >= SINGLE_BYTE_GAIN)
        if sure:
            applied.append("ascii>hz")
        return reading if sure else match.group()

    if "\x0e" in text:
        new = _SHIFTED.sub(shifted, text)
        text = _DESIGNATED.sub("", new) if new != text else text
    return _BRACED.sub(braced, text)


def _utf7_repair(text: str, model: PairModel, applied: list[str]) -> str:
    """``text`` with the stretches read that are UTF-7, by their letters together or by what is probable."""
    readings = {}
    for stretch in set(_BASE64.findall(text)):
        reading = _decoded(f"{stretch.removesuffix('-')}-".encode("ascii"), "utf-7")
        if _readable(reading) and not reading.isascii():
            readings[stretch] = reading
    letters = {stretch: _letters_of_small_scripts(reading) for stretch, reading in readings.items() if stretch.endswith("-")}
    together = sum(letters.values()) >= EVIDENT_LETTERS and sum(map(bool, letters.values())) > 1

    def sure(match: re.Match) -> bool:
        stretch = match.group()
        if stretch not in readings:
            return False
        evident = _letters_of_small_scripts(readings[stretch]) >= EVIDENT_LETTERS or together and letters.get(stretch)
        return bool(evident) or _gain(text, *match.span(), readings[stretch], model) >= SINGLE_BYTE_GAIN

    def fixed(match: re.Match) -> str:
        reading = readings.get(match.group())
        return reading if reading is not None and (match.start() in held or model.knows(reading)) else match.group()

    # Where some stretches are sure, those of characters that the corpus knows are too.
    held = {match.start() for match in _BASE64.finditer(text) if sure(match)} if readings else set()
    if not held:
        return text
    applied.append("ascii>utf-7")
    return _BASE64.sub(fixed, text)


def _wide_readings(shown: str) -> Iterator[tuple[str, str]]:
    """(text, mapping) for each way to read ``shown`` as two or four bytes a character."""
    raws = {}
    for wrong in WRONG[:1] if shown.isascii() else WRONG:
        raw = unread(shown, wrong)
        if raw is not None:
            raws.setdefault(raw, wrong)
    for raw, wrong in raws.items():
        for encoding in ("utf-16-le", "utf-16-be"):
            reading = _decoded(raw, encoding)
            if reading is None:
                continue
            for nulls, others in ((reading[1::2], reading[::2]), (reading[::2], reading[1::2])):
                if nulls and not nulls.strip("\0") and "\0" not in others:
                    yield others.lstrip("\ufeff"), f"{wrong}>{encoding.replace('16', '32')}"
            yield reading.lstrip("\ufeff"), f"{wrong}>{encoding}"


def _wide_repair(text: str, model: PairModel, applied: list[str]) -> str:
    """``text`` with the stretches read that have a control as every second character, or read as a whole.

    The stretches are the maximal scoring segments of the controls at even and at odd places.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    control = (codes < 9) | (codes > 13) & (codes < 32)
    whole = 0 < len(text) == len(text) // 2 * 2 and (text.isascii() or control.any())
    if whole and model.best_log - (before := model.likelihood(f" {text} ")) >= SINGLE_BYTE_GAIN:
        gains = [(gain, reading, mapping) for reading, mapping in _wide_readings(text) if (gain := model.likelihood(f" {reading} ") - before) >= SINGLE_BYTE_GAIN and model.knows(reading) and _readable(reading)]
        if gains:
            applied.append(max(gains)[2])
            return max(gains)[1]
    found = []
    for first in (0, 1) if control.any() else ():
        units = control[first::2]
        for start, end in maximal_segments(np.where(units, 1.0, -1.0)):
            net, begin, size = 2 * int(units[start:end].sum()) - (end - start), first + 2 * start, 2 * (end - start)
            around = max(0, begin - 3), min(len(text), begin + size + 2)
            before = model.likelihood(f" {text[slice(*around)]} ")
            for low in (begin - 1, begin):
                low = low + 2 if low < 0 else low
                high = low + (min(begin - (low < begin) + size, len(text)) - low) // 2 * 2
                marked = low >= 2 and any(unread(text[low - 2 : low], wrong) in (b"\xff\xfe", b"\xfe\xff") for wrong in WRONG)
                low -= 2 * marked
                for reading, mapping in _wide_readings(text[low:high]):
                    head, tail = text[around[0] : low], text[high : around[1]]
                    gain = model.likelihood(f" {head}{reading}{tail} ") - before
                    if _readable(reading) and len(set(reading)) > 1 and (net >= EVIDENT_LETTERS or gain >= SINGLE_BYTE_GAIN):
                        bounded = (not low or text[low - 1].isspace()) + (high == len(text) or text[high].isspace())
                        found.append((net, marked, CONTROL.search(head + tail) is None, gain, bounded, mapping.endswith("le"), low, high, reading, mapping))
    out, taken = [], np.zeros(len(text), bool)
    for *_, low, high, reading, mapping in sorted(found, reverse=True):
        if not taken[low:high].any():
            taken[low:high] = True
            out.append((low, high, reading))
            applied.append(mapping)
    for low, high, reading in sorted(out, reverse=True):
        text = text[:low] + reading + text[high:]
    return text


def _may_hide(text: str) -> bool:
    """Whether ``text`` has what shows the encodings that shift in ASCII, or controls."""
    return any(mark in text for mark in ("+", "(B", "(J", "~}")) or CONTROL.search(text) is not None


def _hidden_repair(text: str, model: PairModel) -> tuple[str, list[str]]:
    """``text`` with what encodings show as ASCII and controls read, and the mappings applied."""
    applied: list[str] = []
    hides = _may_hide(text)
    if hides:
        text = _escaped_repair(text, applied)
        text = _unescaped_repair(text, model, applied)
        text = _shifted_repair(text, model, applied)
        text = _utf7_repair(text, model, applied)
    if text.isascii() or hides and CONTROL.search(text):
        text = _wide_repair(text, model, applied)
    return text, applied


def repair(text: str, model: PairModel, segments: list[tuple[int, int]] | None = None) -> tuple[str, list[str], bool]:
    """(restored text, mappings applied, whether characters are lost for good); ``segments`` are those of the text, if known."""
    applied: list[str] = []
    seen = {text}
    while True:
        text, hidden = _hidden_repair(text, model)
        text, evident = _evident_repair(text)
        applied += hidden + [f"{wrong}>utf-8" for wrong in evident]
        held = sorted({a[: -len(">utf-8")] for a in applied if a.endswith(">utf-8")})
        if segments is None or hidden or evident:
            segments = maximal_segments(-model.scores(_codes(text)))
        out, done, changed, lost = [], 0, bool(hidden or evident), False
        for start, end in segments:
            start, end = _widened(text, max(0, min(start - 1, len(text))), max(0, min(end, len(text))))
            start = max(start, done)
            if start >= end:
                continue
            piece = text[start:end]

            def fixed(match: re.Match, piece: str = piece, held: list[str] = held) -> str:
                run = match.group()
                left, right = piece[max(0, match.start() - 1) : match.start()] or " ", piece[match.end() : match.end() + 1] or " "
                hit = model.remembered((left, run, right), lambda: _utf8_repair(run, left, right, model) or _partial_repair(run, left, right, model))
                hit = hit or _known_repair(run, held, model)
                if not hit:
                    return run
                applied.append(f"{hit[1]}>utf-8")
                return hit[0]

            new = RUN.sub(fixed, piece)
            if new == piece and sum(map(len, NON_ASCII.findall(piece))) >= 3 and LOST not in piece:
                hit = model.remembered((piece,), lambda piece=piece: _single_byte_repair(f" {piece} ", model))
                if hit:
                    new = hit[0].strip(" ")
                    applied.append(hit[1])
            lost = lost or _LETTER_BESIDE_LOST.search(new) is not None
            out += [text[done:start], new]
            changed |= new != piece
            done = end
        text, segments = "".join([*out, text[done:]]), None
        if not changed or text in seen:
            return text, applied, lost
        seen.add(text)


def searched(texts: list[str], model: PairModel) -> Iterator[tuple[str, list[str], bool] | None]:
    """The repair of each text, None where it shows nothing improbable; the pairs of all texts are scored at once.

    Pairs of ASCII are plain, so texts of ASCII have no segments.
    """
    codes = [np.empty(0, np.uint32) if text.isascii() else _codes(text) for text in texts]
    scores = model.scores(np.concatenate(codes)) if any(map(len, codes)) else np.empty(0)
    start = 0
    for text, own in zip(texts, codes, strict=True):
        segments = maximal_segments(-scores[start : start + len(own) - 1]) if len(own) else []
        start += len(own)
        yield repair(text, model, segments) if segments or text.isascii() or _may_hide(text) or _may_be_evident(text) else None


def _may_be_evident(text: str) -> bool:
    """Whether a run of the text can be read as UTF-8 at all."""
    return any(len(run) > 1 and _shown(run) for run in NON_ASCII.findall(text))


def fit_pairs(texts: DataFrame) -> PairModel:
    """Pair counts over all texts; collects at most 2^18 + 2^15 numbers and two."""
    rows = texts.mapInArrow(_count, "kind int, bin long, n long").groupBy("kind", "bin").agg(F.sum("n").alias("n")).toPandas()
    arrays = [np.zeros(1 << PAIR_BITS, np.int64), np.zeros(1 << CHAR_BITS, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)]
    for kind, part in rows.groupby("kind"):
        arrays[kind][part["bin"].to_numpy()] = part["n"].to_numpy()
    return PairModel(arrays[0], arrays[1], int(arrays[2][0]), int(arrays[3][0]))


def garbled(documents: DataFrame) -> DataFrame:
    """(doc_id, restored, mappings, lost) of the documents with wrongly decoded text in any part.

    ``restored`` is the text with every run repaired that could be; ``lost`` tells that replacement characters
    remain. Null and empty texts are no case. Repeated rows count once. A text without a doc_id is counted
    like all others, but no row of the result can name it.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    model = spark.sparkContext.broadcast(fit_pairs(texts))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, found in zip(batch["doc_id"].to_pylist(), searched(batch["text"].to_pylist(), model.value), strict=True):
                if found is not None and (found[1] or found[2]):
                    rows.append((doc, found[0], sorted(set(found[1])), found[2]))
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.list_(pa.string())), pa.array(columns[3], pa.bool_())], ["doc_id", "restored", "mappings", "lost"])

    return texts.where("doc_id is not null").mapInArrow(search, "doc_id long, restored string, mappings array<string>, lost boolean").dropDuplicates(["doc_id", "restored"])
