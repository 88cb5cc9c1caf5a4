"""Problem 5: repairing text that was recognised from scanned pages."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.llm.near_duplicates import _mix
from folioscope.operators.lineage import materialize

#: What recognition writes, and what the page may have had instead.
CONFUSIONS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("l", "i"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("c", "e"), ("f", "t"), ("v", "y"), ("ä", "a"), ("í", "i"),
    ("¢", "c"), ("†", "t"), ("#", "l"), ("|", "l"), ("|", "i"), ("!", "l"), ("!", "i"), ("$", "s"), ("@", "a"), ("€", "e"), ("£", "e"),
    ("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("vv", "w"), ("m", "rn"), ("m", "in"), ("d", "cl"), ("h", "li"), ("ni", "m"),
]
#: Specks that are read as characters inside a word.
SPECKS = "·|^~°'`¨*_"
#: Strokes of letters; letters and groups that are confused have equal strokes.
_STROKES = {"m": "iii", "n": "ii", "u": "ii", "h": "ii", "b": "ii", "r": "i", "l": "i", "w": "vv", "d": "ci", "t": "f", "e": "c", "y": "v", "0": "o", "1": "i", "5": "s", "6": "ii", "8": "ii", "9": "g", "ä": "a", "í": "i", "¢": "c", "†": "f", "#": "i", "!": "i", "$": "s", "@": "a", "€": "c", "£": "c"}
_TO_STROKES = str.maketrans(_STROKES | dict.fromkeys(SPECKS, ""))
_FROM = {o: [t for a, t in CONFUSIONS if a == o] for o, _ in CONFUSIONS}

#: Hyphens at the end of a line that break a word, and what may stand between: ends of lines, a header and a page number.
_HYPHENS = "-‐‑\xad¬"
_BREAKS = frozenset(_HYPHENS)
_BROKEN = re.compile(rf"([^\W\d_]+)[{_HYPHENS}][^\S\n]*$")
_ENDS = tuple(f"{h}{e}" for h in _HYPHENS for e in ("\n", "\r", " \n"))
_CONTINUED = re.compile(r"\s*([^\W\d_]+)")
_NUMBER_LINE = re.compile(r"(?:[-–—·|\[]|p\.|page|pg\.?)?\s*([0-9OIlSBo]{1,5})\s*(?:[-–—·|\]])?", re.IGNORECASE)
_MISREAD_DIGITS = str.maketrans("OoIlSBZ", "0011582")
_MISREAD_NUMBER = re.compile(r"(?=[^A-Za-z]*[OoIlSBZ])(?=[OoIlSBZ.,%]*[0-9])(?:[0-9OoIlSBZ]+[.,])*[0-9OoIlSBZ]+%?")
_MIXED = re.compile(r"[0-9][.,]?[OoIlSBZ]|[OoIlSBZ][.,]?[0-9]")
_WORD = re.compile(r"[^\s\-‐‑–—/()\[\]{}\"“”,;:?]+")
_EDGE = ".!?'’‘*"
#: Marks where a word was closed up; such words are no evidence for a form.
_JOINT = "\x01"
_CODE = re.compile(r"[_=<>\\(){}+\x01]")
_CONTRACTED = re.compile(r".*['’](?:s|t|re|ve|m|ll|d)")

FOUND = "chunk_id string, noise string"


def stroke_skeleton(word: str) -> str:
    """The form that a word shares with all its confusable readings."""
    return word.lower().translate(_TO_STROKES).replace("j", "i")


def reads_as(word: str, right: str, depth: int = 2) -> bool:
    """Whether ``right`` is what ``word`` may stand for, up to ``depth`` confusions or specks away."""
    i = 0
    while i < len(word) and i < len(right) and word[i] == right[i]:
        i += 1
    word, right = word[i:], right[i:]
    if word == right:
        return True
    if not depth or not word:
        return False
    if word[0] in SPECKS and reads_as(word[1:], right, depth - 1):
        return True
    # No confusion begins with the letter it replaces, so the first difference is where one begins.
    return any(right.startswith(t) and reads_as(word[size:], right[len(t) :], depth - 1) for size in (1, 2) for t in _FROM.get(word[:size], ()))


def is_misread_number(token: str) -> bool:
    """A number in which letters stand for digits; a symbol such as R2, 2B or O is none."""
    return len(token) > 1 and bool(_MISREAD_NUMBER.fullmatch(token)) and sum(c.isdigit() for c in token) >= sum(c.isalpha() for c in token) and not (len(token) == 2 and (token[0].isalpha() or token[1] in "BSZI"))


def is_page_number(line: str, start: int | None, end: int | None) -> bool:
    """Whether the line shows only a page number from start to end; an unknown end counts as the start or the page after it."""
    if start is None and end is None:
        return False
    m = _NUMBER_LINE.fullmatch(line.strip())
    if not m or line.strip().startswith("(") or not (digits := m[1].translate(_MISREAD_DIGITS)).isdigit():
        return False
    low = end if start is None else start
    high = low + 1 if end is None else end
    return low <= int(digits) <= high


_NUMBERED = re.compile(r"\s*(?:[0-9]{1,5}\s*(?:\||\s{2,})\s*)?(.*?)(?:\s{2,}\|?\s*[0-9]{1,5}|\s*\|\s*[0-9]{1,5})?\s*")


def header_text(line: str) -> str:
    """A line without a page number at either side."""
    return _NUMBERED.fullmatch(line)[1] if (line := line.replace("\n", " ")) else ""


def may_be_header(line: str) -> bool:
    """Whether a line starts and ends as titles and names do."""
    line = line.strip()
    if len(line) < 3 or line[-1] in ".,;:-" and not line.lower().endswith("al.") or line[0].islower():
        return False
    text = header_text(line)
    return len(text) >= 3 and not text[0].islower() and any(c.isalpha() for c in text)


def _folded(text: str) -> str:
    """Letters of any script by their strokes; digits, marks and accents vanish."""
    plain = unicodedata.normalize("NFD", unicodedata.normalize("NFC", text).lower().translate(_TO_STROKES))
    return "".join(c for c in plain if c.isalpha()).replace("j", "i")


def _plain_line(line: str) -> str:
    return " ".join(line.lower().split())


def masked(line: str) -> str:
    """A line without its page number, in single spaces, with digits masked, so that all its copies are one."""
    return re.sub(r"[0-9]", "#", " ".join(header_text(line).split()))


def _near(a: str, b: str) -> bool:
    """Equal but for a tenth of the characters, by a banded edit distance."""
    most = max(len(a), len(b)) // 10
    if a == b or abs(len(a) - len(b)) > most:
        return a == b
    size, middle = min(6, len(b) // 2), len(b) // 2
    if b[:size] not in a and b[-size:] not in a and b[middle : middle + size] not in a:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        low, high = max(1, i - most), min(len(b), i + most)
        if low > 1:
            last, row[low - 1] = row[low - 1], most + 1
        for j in range(low, high + 1):
            last, row[j] = row[j], min(last + (x != b[j - 1]), row[j] + 1, row[j - 1] + 1)
        if high < len(b):
            row[high + 1] = most + 1
    return row[-1] <= most


def _letters(text: str) -> str:
    return re.sub(r"[\W\d_]+", "", unicodedata.normalize("NFC", text).lower())


def header_lines(title: str | None, authors: list[str] | None) -> list[str]:
    """What a running header may say: the title, the title up to its colon, the authors' surnames."""
    lines = [title, title.split(":")[0]] if title else []
    names = [n.split(",")[0].strip() if "," in n else n.split()[-1] for n in authors or [] if n and n.strip()]
    if names:
        joined = [" and ".join(names), ", ".join(names), ", ".join(names[:-1]) + " and " + names[-1], f"{names[0]} et al."]
        lines += joined if len(names) > 1 else names
    return [x for x in lines if x]


def header_forms(title: str | None, authors: list[str] | None) -> dict[str, set[str]]:
    """Forms of the lines that a running header may be, of at least four letters: folded, with the letters of each."""
    out: dict[str, set[str]] = {}
    for x in header_lines(title, authors):
        if len(f := _folded(x)) >= 4:
            out.setdefault(f, set()).add(_letters(x))
    return out


def _ends_broken(line: str) -> bool:
    return line.rstrip()[-1:] in _BREAKS


def _continuation(lines: list[str], i: int, skip: set[int]) -> tuple[int, str, re.Match] | None:
    """Where the word that line i breaks goes on, its first half and the match of its second; None if line i breaks none."""
    if i in skip or not _ends_broken(lines[i]) or not (m := _BROKEN.search(lines[i])):
        return None
    j = i + 1
    while j < len(lines) and (j in skip or not lines[j].strip()):
        j += 1
    if j == len(lines) or (j > i + 1 and not any(k in skip for k in range(i + 1, j))):
        return None
    n = _CONTINUED.match(lines[j])
    if not n or n[1] in ("and", "or", "to", "und", "oder") or not (n[1][0].islower() or m[1][0].isupper() and n[1][0].isupper()):
        return None
    return j, m[1], n


def _dehyphenated(lines: list[str], skip: set[int]) -> tuple[list[str], set[int]]:
    """Lines with broken words joined across ends of lines, headers, page numbers and blank lines; and the lines that ended in a break."""
    lines, broken = list(lines), set()
    for i in range(len(lines) - 1):
        if not (met := _continuation(lines, i, skip)):
            continue
        j, _, n = met
        end = n.end()
        while end < len(lines[j]) and not lines[j][end].isspace():
            end += 1
        lines[i] = lines[i].rstrip()[:-1] + _JOINT + lines[j][:end].lstrip()
        lines[j] = lines[j][end:].lstrip()
        broken.add(i)
    return lines, broken


def _lines(text: str) -> list[str]:
    return text.replace("\r\n", "\n").split("\n")


class _Cached(dict):
    """Results by word, counted anew when many have come together."""

    def __init__(self, make: Callable[[str], str | None], most: int = 500_000) -> None:
        self.make, self.most = make, most

    def __missing__(self, key: str) -> str | None:
        if len(self) > self.most:
            self.clear()
        self[key] = value = self.make(key)
        return value


def _scan(batches: Iterator[pa.RecordBatch], titles: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What one pass over the chunks can tell: page numbers, lines that may be headers (``titles`` is a sieve of their plain lines), ends of lines that may be breaks, misread numbers."""
    bits, known = len(titles) * 8, titles.tobytes()

    def is_line(line: str) -> bool:
        if may_be_header(line):
            return True
        line = line.strip()
        numbered = line[0].isdigit() or line[-1].isdigit() or "|" in line
        h = _hash(_plain_line(header_text(line) if numbered else line)) % bits
        return bool(known[h >> 3] >> (h & 7) & 1)

    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("chunk_id", "source_id", "kind", "line_no", "line")}
        for key, source, text, start, end in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            lines = _lines(text)
            pages = {i for i, x in enumerate(lines) if x.strip() and is_page_number(x, start, end)}
            heads = {i for i, x in enumerate(lines) if i not in pages and x.strip() and is_line(x)} if len(lines) > 1 else set()
            found = [("page_number", i, None) for i in pages]
            found += [("line", i, masked(lines[i].strip())) for i in heads]
            if any(h in text for h in _ENDS):
                found += [("end", i, x) for i, x in _break_candidates(lines, pages, heads)]
            if _MIXED.search(text) and any(is_misread_number(w.strip(_EDGE)) for w in _WORD.findall(text)):
                found.append(("misread", -1, None))
            for kind, i, x in found:
                for name, value in zip(out, (key, source, kind, i, x), strict=True):
                    out[name].append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out["chunk_id"], pa.string()), pa.array(out["source_id"], pa.string()), pa.array(out["kind"], pa.string()), pa.array(out["line_no"], pa.int32()), pa.array(out["line"], pa.string())], list(out))


def _break_candidates(lines: list[str], pages: set[int], heads: set[int]) -> list[tuple[int, str]]:
    """Ends of lines that break a word: a certain one as an empty string; else, for each break and each number of lines after it that would have to be headers, the numbers of these lines under one name."""
    for i in range(len(lines) - 1):
        if _continuation(lines, i, pages):
            return [(i, "")]
    unsure = []
    for i in range(len(lines) - 2):
        if i in pages or not _ends_broken(lines[i]) or not _BROKEN.search(lines[i]):
            continue
        between: list[int] = []
        for j in range(i + 1, len(lines)):
            if j in heads:
                between.append(j)
                if _continuation(lines, i, pages | set(between)):
                    unsure += [(k, f"{i}:{len(between)}") for k in between]
            elif j not in pages and lines[j].strip():
                break
    return unsure


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forms of words and in how many of the task's chunks they occur; sent when many have come together."""

    def packed(counts: Counter) -> pa.RecordBatch:
        forms = list(counts)
        return pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), pa.array([stroke_skeleton(f) for f in forms], pa.string()), pa.array([counts[f] for f in forms], pa.int64())], ["form", "skeleton", "n"])

    counts: Counter = Counter()
    forms = _Cached(_form)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            words = set(_word_list(text))
            counts.update({forms[w] for w in words})
            for w in words:
                if _JOINT in w and (form := _form(w.replace(_JOINT, ""))):
                    counts.setdefault(form, 0)  # to be judged, but no evidence for itself
        counts.pop(None, None)
        if len(counts) > 500_000:
            yield packed(counts)
            counts = Counter()
    yield packed(counts)


def _form(part: str) -> str | None:
    """A word as it is counted; None for code, numbers and what is very short."""
    form = part.strip(_EDGE).lower()
    return None if _CODE.search(form) or len(form) < 3 or form.replace(".", "").replace("%", "").isdigit() else form


def _word_list(text: str) -> list[str]:
    """The words of a text in order, broken ones joined; halves that a header keeps apart are left out."""
    if any(h in text for h in _ENDS):
        lines = _dehyphenated(_lines(text), set())[0]
        for i in range(len(lines)):
            if _ends_broken(lines[i]) and (m := _BROKEN.search(lines[i])):
                lines[i] = lines[i][: m.start()]
                for j in range(i + 1, len(lines)):
                    go_on = not lines[j].strip() or may_be_header(lines[j])
                    lines[j] = lines[j].lstrip().partition(" ")[2]
                    if not go_on:
                        break
        text = "\n".join(lines)
    return _WORD.findall(text)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs of a rare and a frequent form of one skeleton, those whose rare form may stand for the frequent one."""
    for batch in batches:
        pairs = zip(batch.column("form").to_pylist(), batch.column("right").to_pylist(), strict=True)
        good = [not _CONTRACTED.fullmatch(f) and reads_as(f, r) for f, r in pairs]
        yield batch.filter(pa.array(good, pa.bool_()))


def misread_forms(chunks: DataFrame, ratio: int = 8) -> tuple[DataFrame, DataFrame]:
    """form, right and n: rare words, the frequent words that each may have been read from and their counts; and the vocabulary (skeleton, form, n).

    Words are counted by chunks, and a form is
    misread if a word of its stroke skeleton at least ``ratio`` times as frequent is at most two
    confusions away. Only counts of forms are shuffled, combined within each
    task; rare forms are joined with the frequent ones of their skeleton, so no skeleton's forms come together in one row.
    """
    texts = chunks.where("content IS NOT NULL").select("content")
    counted = texts.mapInArrow(_vocabulary, "form string, skeleton string, n bigint").groupBy("skeleton", "form").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "vocabulary")
    right = counted.where((F.col("n") >= 3) & F.col("form").rlike(r"^\p{L}+$")).select("skeleton", F.col("form").alias("right"), F.col("n").alias("n_right"))
    pairs = counted.join(right, "skeleton").where((F.col("n_right") >= ratio * F.col("n")) & (F.col("form") != F.col("right")))
    pairs = pairs.select("form", "right", F.col("n_right").alias("n"))
    return materialize(pairs.mapInArrow(_judge, "form string, right string, n bigint"), "misread"), counted


class _Sieve:
    """A bitmap over 64-bit hashes, for a first look; joins decide. It has 16 bits or more for each hash, up to 32 MB, beyond which it lets more pass."""

    least, most = 1 << 22, 1 << 28

    @classmethod
    def of(cls, rows: DataFrame) -> np.ndarray:
        """The bitmap of a column ``h``: one of each partition, joined in four tasks before they come to the driver."""
        rows, bits = rows.select("h"), cls.least
        n = rows.count()
        while bits < min(cls.most, 16 * n):
            bits *= 2

        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            marks = np.zeros(bits // 8, np.uint8)
            for batch in batches:
                at = np.asarray(batch.column(0)).view(np.uint64) % np.uint64(bits)
                np.bitwise_or.at(marks, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([marks.tobytes()], pa.binary())], ["marks"])

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            marks = np.zeros(bits // 8, np.uint8)
            for batch in batches:
                for part in batch.column(0):
                    marks |= np.frombuffer(part.as_buffer(), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([marks.tobytes()], pa.binary())], ["marks"])

        few = rows.coalesce(max(1, min(64, (1 << 31) // bits))).mapInArrow(marked, "marks binary")
        parts = few.repartition(4).mapInArrow(joined, "marks binary").collect()
        return np.bitwise_or.reduce([np.frombuffer(p["marks"], np.uint8) for p in parts] or [np.zeros(bits // 8, np.uint8)])

    @classmethod
    def hits(cls, marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = hashes % np.uint64(8 * len(marks))
        return (marks[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _hash(form: str | None) -> int:
    return xxhash.xxh3_64_intdigest(form) if form else 0


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words; 0 where one is none."""
    return np.where((left == 0) | (right == 0), np.uint64(0), _mix(left * np.uint64(0x9E3779B97F4A7C15 | 1) ^ _mix(right)))


def _hashed_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.array([_hash(f) for f in batch.column(0).to_pylist()], np.uint64).view(np.int64))], ["h"])


def _suspects(batches: Iterator[pa.RecordBatch], marks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """chunk_id, form and the words before and after it, of forms that pass the sieve."""

    def suspect(part: str) -> str | None:
        form = _form(part.replace(_JOINT, ""))
        return form if form and _Sieve.hits(marks, np.array([_hash(form)], np.uint64))[0] else None

    marked, forms = _Cached(suspect), _Cached(lambda part: _form(part.replace(_JOINT, "")))
    for batch in batches:
        out: list[tuple] = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parts = _word_list(text)
            if any(marked[w] for w in set(parts)):
                own = [forms[w] for w in parts]
                out += [(key, f, own[i - 1] if i else None, own[i + 1] if i + 1 < len(own) else None) for i, f in enumerate(own) if f and marked[parts[i]]]
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], ["chunk_id", "form", "before", "after"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suspects with the hashes of four pairs: the right form with the words before and after it, then the form as it stands."""
    for batch in batches:
        h = {c: np.array([_hash(f) for f in batch.column(c).to_pylist()], np.uint64) for c in ("form", "right", "before", "after")}
        keys = np.stack([_pairs(h["before"], h["right"]), _pairs(h["right"], h["after"]), _pairs(h["before"], h["form"]), _pairs(h["form"], h["after"])], 1)
        offsets = pa.array(np.arange(0, keys.size + 1, 4, dtype=np.int32))
        yield batch.append_column("keys", pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64))))


def _pair_counts(batches: Iterator[pa.RecordBatch], marks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How often the pairs that pass the sieve occur in the texts."""
    hashes = _Cached(lambda part: _hash(_form(part.replace(_JOINT, ""))))
    for batch in batches:
        parts: list[str] = []
        for text in batch.column(0).to_pylist():
            parts += _word_list(text)
            parts.append("")
        words = np.fromiter(map(hashes.__getitem__, parts), np.uint64, len(parts))
        keys = _pairs(words[:-1], words[1:])
        keys = keys[keys != 0]
        keys, counts = np.unique(keys[_Sieve.hits(marks, keys)], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["key", "n"])


def misread_words(rows: DataFrame, forms: DataFrame) -> DataFrame:
    """chunk_id, form and right of the misread words of chunks (id, content), as their context supports them.

    Each place of a suspect form is asked how often the words beside it stand
    next to the right form elsewhere, and how often next to the form itself. The
    form stays where its own neighbours speak for it; of several right forms the
    best supported, then the most frequent one is taken. Only suspects and
    the counts of pairs that they ask for leave the pass over the texts.
    """
    marks = _Sieve.of(forms.select("form").mapInArrow(_hashed_forms, "h bigint"))
    found = rows.select("id", "content").mapInArrow(lambda it: _suspects(it, marks), "chunk_id string, form string, before string, after string").distinct()
    asked = found.join(forms, "form").select("chunk_id", "form", "before", "after", "right", "n").mapInArrow(_asked, "chunk_id string, form string, before string, after string, right string, n bigint, keys array<bigint>")
    asked = materialize(asked, "suspects")
    wanted = _Sieve.of(asked.select(F.explode("keys").alias("h")).where("h <> 0"))
    counts = rows.select("content").mapInArrow(lambda it: _pair_counts(it, wanted), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("met"))
    met = asked.select("chunk_id", "form", "right", "n", F.posexplode("keys").alias("at", "key")).join(counts, "key", "left").fillna(0, ["met"])
    by = met.groupBy("chunk_id", "form", "right", "n").agg(F.sum(F.when(F.col("at") < 2, F.col("met")).otherwise(0)).alias("right_met"), F.sum(F.when((F.col("at") >= 2) & (F.col("met") > 0), F.col("met") - 1).otherwise(0)).alias("form_met"))
    best = Window.partitionBy("chunk_id", "form").orderBy(F.desc("right_met"), F.desc("n"), "right")
    return by.where("right_met >= form_met").withColumn("at", F.row_number().over(best)).where(F.col("at") == 1).select("chunk_id", "form", "right")


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known: dict[tuple, dict[str, set[str]]] = {}
        keep, wrong = [], []
        for k, (line, title, authors) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("line", "title", "authors")), strict=True)):
            about = (title, tuple(authors or ()))
            if about not in known:
                known[about] = header_forms(title, authors)
            folded = _folded(line)
            if folded and (met := [f for f in known[about] if _near(folded, f)]):
                keep.append(k)
                wrong.append(_letters(line) not in set().union(*(known[about][f] for f in met)))
        rows = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("source_id").take(rows), batch.column("line").take(rows), pa.array(wrong, pa.bool_())], ["source_id", "line", "wrong"])


def _title_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = [_plain_line(header_text(x)) for t, a in zip(*(batch.column(c).to_pylist() for c in ("title", "authors")), strict=True) for x in header_lines(t, a)]
        yield pa.RecordBatch.from_arrays([pa.array(np.array([_hash(x) for x in lines if x], np.uint64).view(np.int64))], ["h"])


def find_noise(chunks: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Noise of the chunks: (chunk_id, noise) rows; (chunk_id, line_no) of headers and page numbers; (chunk_id, form, right) of misread words; the vocabulary.

    hyphenation: a word or hyphenated compound broken over the end of a line or
    page, a header or page number between the halves included; not a hyphen
    that stands for a common ending ("pre- and post-treatment"). misread: a
    rare form whose stroke skeleton it shares with a frequent word that its
    context supports (see misread_forms, misread_words), a header that has other letters than the title or names it
    repeats, or a number holding letters for digits. header: a line that
    repeats the source's title, whole or up to its colon, or its authors'
    surnames, in any case and script, with or without a page number; digits are masked, so that copies of a line are compared once,
    and glyphs compared by strokes, so that a misread header is one too.
    page_number: a line that shows only a number from page_start to page_end.

    Only short lines are joined with sources; contents never move. Null, empty
    and blank contents have no noise; without pages no page number, without a
    source, title and authors no header. A row delivered twice counts once.
    """
    rows = chunks.where("id IS NOT NULL AND content IS NOT NULL").select("id", "source_id", "content", "page_start", "page_end")
    about = sources.select(F.col("id").alias("source_id"), "title", "authors").dropDuplicates(["source_id"])
    titles = _Sieve.of(about.select("title", "authors").mapInArrow(_title_hashes, "h bigint"))
    seen = materialize(rows.mapInArrow(lambda it: _scan(it, titles), "chunk_id string, source_id string, kind string, line_no int, line string").distinct(), "lines")
    # Copies of a line, its digits masked, are compared once for each source, then found again where they stand.
    lines = seen.where("kind = 'line'")
    repeated = lines.groupBy("source_id", "line").agg(F.count("*").alias("n"))
    known = materialize(repeated.join(about, "source_id").mapInArrow(_headers, "source_id string, line string, wrong boolean"), "header_lines")
    headers = materialize(lines.join(known, ["source_id", "line"]).select("chunk_id", "line_no", "wrong"), "headers")
    needed = seen.where("kind = 'end' AND line <> ''").select("chunk_id", "line_no", "line")
    held = needed.join(headers.select("chunk_id", "line_no", F.lit(1).alias("held")), ["chunk_id", "line_no"], "left")
    unsure = held.groupBy("chunk_id", "line").agg(F.count("*").alias("n"), F.count("held").alias("held")).where("n = held").select("chunk_id").distinct()
    found = seen.where("kind IN ('page_number', 'misread')").select("chunk_id", F.col("kind").alias("noise"))
    found = found.unionByName(headers.select("chunk_id", F.lit("header").alias("noise")))
    found = found.unionByName(headers.where("wrong").select("chunk_id", F.lit("misread").alias("noise")))
    headers = headers.select("chunk_id", "line_no")
    found = found.unionByName(seen.where("kind = 'end' AND line = ''").select("chunk_id", F.lit("hyphenation").alias("noise")))
    found = found.unionByName(unsure.select("chunk_id", F.lit("hyphenation").alias("noise")))
    forms, vocabulary = misread_forms(rows)
    misread = materialize(misread_words(rows, forms), "misread_at")
    found = found.unionByName(misread.select("chunk_id", F.lit("misread").alias("noise"))).distinct()
    dropped = seen.where("kind = 'page_number'").select("chunk_id", "line_no").unionByName(headers).distinct()
    return found, dropped, misread, vocabulary


def _replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their misread words and numbers put right."""
    for batch in batches:
        out = []
        for line, fixes in zip(batch.column("line").to_pylist(), batch.column("fixes").to_pylist(), strict=True):
            right = {f["form"]: f["right"] for f in fixes or []}

            def put(m: re.Match, right: dict[str, str] = right) -> str:
                word = m[0].strip(_EDGE)
                if not word:
                    return m[0]
                if is_misread_number(word):
                    return m[0].replace(word, word.translate(_MISREAD_DIGITS))
                new = right.get(word.lower())
                if new is None:
                    return m[0]
                letters = [c for c in word if c.isalpha()]
                new = new.upper() if len(letters) > 1 and all(c.isupper() for c in letters) else new.capitalize() if word[:1].isupper() else new
                return m[0].replace(word, new)

            out.append(_WORD.sub(put, line))
        yield batch.drop_columns(["line", "fixes"]).append_column("line", pa.array(out, pa.string()))


def repair(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """chunk_id and ``content``: noisy chunks as continuous paragraphs, all others unchanged.

    Only noisy chunks are cut into lines. Headers and page numbers go, misread
    words and numbers take their right form, and SQL windows reflow the rest:
    within a chunk, ordered by line, a line ending in a hyphen is closed up with
    the next (its hyphen stays unless the closed-up form is a word of the corpus,
    as in "kernel-weighted"), lists, tables and code keep
    their lines, other lines join up to the next blank one. A paragraph that a
    page break cuts goes on if its line ended within a sentence.

    Null and blank contents come out as they are; a row delivered twice comes
    out once.
    """
    found, dropped, misread, vocabulary = find_noise(chunks, sources)
    rows = chunks.where("id IS NOT NULL").select(F.col("id").alias("chunk_id"), "content").dropDuplicates(["chunk_id"])
    noisy = found.select("chunk_id").distinct()
    joined = rows.join(noisy.withColumn("noisy", F.lit(True)), "chunk_id", "left")
    clean = joined.where("noisy IS NULL").select("chunk_id", "content")
    lines = joined.where("noisy").select("chunk_id", F.posexplode(F.split(F.regexp_replace("content", "\r\n", "\n"), "\n")).alias("line_no", "line"))
    gone = dropped.withColumn("gone", F.lit(True))
    fixes = misread.groupBy("chunk_id").agg(F.collect_list(F.struct("form", "right")).alias("fixes"))
    lines = lines.join(gone, ["chunk_id", "line_no"], "left").join(fixes, "chunk_id", "left")
    order = Window.partitionBy("chunk_id").orderBy("line_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(1, Window.unboundedFollowing)
    kept = F.when(F.col("gone").isNull() & (F.trim("line") != ""), F.struct(F.col("line_no").alias("at"), F.rtrim("line").alias("text")))
    # A word broken over the end of a line is closed up before its letters are compared with misread forms.
    lines = lines.withColumn("before", F.last(kept, True).over(so_far)).withColumn("after", F.first(kept, True).over(later)).withColumn("page_break", F.coalesce(F.max(F.col("gone").cast("int")).over(order.rowsBetween(-2, -1)), F.lit(0)) == 1)
    lines = lines.where(F.col("gone").isNull())
    broken = f"[\\p{{L}}][{_HYPHENS}]$"
    begins = F.regexp_extract("line", r"^\s*(\p{L}[^\s]*)", 1)
    continues = F.col("before.text").rlike(broken) & (begins != "") & ~begins.rlike("^(and|or|to)$")
    ends = F.rtrim("line").rlike(broken) & F.regexp_extract("after.text", r"^\s*(\p{L}[^\s]*)", 1).rlike(r"^\p{L}") & ~F.col("after.text").rlike(r"^\s*(and|or|to)\s")
    structured = F.col("line").rlike(r"^\s*([-•*+]\s|\(?\d+[.)]\s|\[\d+\]|#|\||(def|class|return|import)\b|.*\t)|^\s{4,}|\s{3,}\S+\s{3,}")
    next_half = F.regexp_extract("after.text", r"^\s*(\S+)", 1)
    whole = F.lower(F.concat(F.regexp_extract(F.rtrim("line"), rf"(\p{{L}}+)[{_HYPHENS}]$", 1), F.regexp_extract(next_half, r"^(\p{L}+)", 1)))
    lines = lines.withColumn("form", F.when(ends, whole)).join(vocabulary.where("n > 0").select("form", F.lit(True).alias("word")), "form", "left")
    hyphen = F.when(F.rtrim("line").rlike("[-‐‑]$") & F.col("word").isNull(), F.lit("-")).otherwise(F.lit(""))
    lines = lines.withColumn("line", F.when(continues, F.regexp_replace("line", r"^\s*\S+\s*", "")).otherwise(F.col("line")))
    lines = lines.withColumn("line", F.when(ends, F.concat(F.regexp_replace(F.rtrim("line"), f"[{_HYPHENS}]$", ""), hyphen, next_half)).otherwise(F.col("line")))
    lines = lines.withColumn("blank", F.trim("line") == "").withColumn("structured", structured)
    within = F.col("page_break") & F.col("before.text").isNotNull() & ~F.col("before.text").rlike(r"[.!?:][\"'”’)\]]*$")
    last_blank = F.lag("blank", 1, True).over(order)
    last_structured = F.lag("structured", 1, False).over(order)
    starts = (last_blank & ~within) | F.col("structured") | last_structured
    lines = lines.where(~(F.col("blank") & (F.col("page_break") | continues))).withColumn("starts", starts).withColumn("gap", last_blank & ~within)
    lines = lines.select("chunk_id", "line_no", "blank", "starts", "gap", "line", "fixes").mapInArrow(_replaced, "chunk_id string, line_no int, blank boolean, starts boolean, gap boolean, line string")
    parts = lines.where("NOT blank").groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "starts", "gap", F.rtrim("line").alias("line")))).alias("parts"))
    text = F.expr("aggregate(parts, '', (t, l) -> CASE WHEN t = '' THEN l.line WHEN l.gap THEN concat(t, '\n\n', l.line) WHEN l.starts THEN concat(t, '\n', l.line) ELSE concat(t, ' ', ltrim(l.line)) END)")
    repaired = noisy.join(parts, "chunk_id", "left").select("chunk_id", F.coalesce(text, F.lit("")).alias("content"))
    return clean.unionByName(repaired)
