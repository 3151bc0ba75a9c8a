"""Pages as the tagger reads them: a cleaned view, signs as integers, overlapping windows, tags of whole pages.

The cleaned view leaves out what a scanner puts inside words (specks, hyphens at
line ends with the break after them) and has a blank for other line breaks. Every
sign of it knows its offset in the text, so spans are given in the text.
"""

from __future__ import annotations

import re

import numpy as np

from millrace.llm.tagger import BLOCK, FAR

_LETTERS = "äöüÄÖÜßſéèêëàâáíîïóôúûùçñÉÈÀÁÍÓÚÇÑœ"
_SIGNS = "—–•£€°§«»„“”’‘¿¡½¼¾©®"
#: Sign numbers: 0 is padding, 1 any other letter, 2 anything else, then ASCII and what is named above.
ALPHABET = [chr(c) for c in range(0x20, 0x7F)] + list(_LETTERS) + list(_SIGNS)
SIGNS = 3 + len(ALPHABET)

_TABLE = np.full(0x10000, 2, np.uint8)
for _c in range(0xA0, 0x10000):
    if chr(_c).isalpha():
        _TABLE[_c] = 1
for _i, _c in enumerate(ALPHABET):
    _TABLE[ord(_c)] = 3 + _i

_BROKEN = re.compile("([-\xac=\xad])([ \t]*\r?\n[ \t]*)|[\xb7^~\xad\r]")


def clean(text: str) -> tuple[str, np.ndarray]:
    """The cleaned view and the offset of each of its signs in the text.

    A hyphen at a line end goes if the word may go on behind it; between digits it
    stays and the break goes; before another kind of sign (lines of another column
    or an advert may follow) both stay.
    """
    keep, at, pieces = [], 0, []

    def take(a: int, b: int) -> None:
        if b > a:
            pieces.append(text[a:b])
            keep.append((a, b))

    for m in _BROKEN.finditer(text):
        a, b = m.span()
        take(at, a)
        if m.group(1) is not None:
            before, behind = text[a - 1 : a], text[b : b + 1]
            if before.isdigit() and behind.isdigit():
                take(a, a + 1)
            elif not (before.isalpha() and behind.isalpha() and (behind.islower() or before.isupper())):
                if m.group(1) in "-=":
                    take(a, a + 1)
                newline = text.index("\n", a)
                take(newline, newline + 1)
        at = b
    take(at, len(text))
    offsets = np.concatenate([np.arange(a, b) for a, b in keep]) if keep else np.zeros(0, np.int64)
    return "".join(pieces).replace("\n", " ").replace("\t", " "), offsets


def points(view: str) -> np.ndarray:
    """Code points, those beyond the first plane as one sign."""
    return np.minimum(np.frombuffer(view.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)


def encode(codes: np.ndarray) -> np.ndarray:
    return _TABLE[codes]


#: Length and overlap of windows.
WINDOW, OVERLAP = 1280, 48
#: Windows that are scored at once.
BATCH = 192


def windows(spans: np.ndarray) -> np.ndarray:
    """(start, end, first) of the overlapping windows that cover the spans; `first` marks those that begin one.

    Two windows at most share a sign.
    """
    out = []
    step = WINDOW - OVERLAP
    for a, b in spans.tolist():
        if b <= a:
            continue
        for at in range(a, max(a + 1, b - OVERLAP), step):
            out.append((at, min(at + WINDOW, b), at == a))
    return np.array(out, np.int64).reshape(-1, 3)


def scores(tagger, codes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """(1 + kinds, signs): the scores of all signs in windows. In an overlap those of both windows count, each the less the nearer its cut is."""
    signs = encode(codes)
    out = np.zeros((tagger.kinds + 1, len(codes)), np.float32)
    rise = ((np.arange(OVERLAP) + 0.5) / OVERLAP).astype(np.float32)
    begins = np.append(cuts[:, 2] == 1, True)
    lengths = cuts[:, 1] - cuts[:, 0]
    order = np.argsort(lengths, kind="stable")
    for at in range(0, len(cuts), BATCH):
        rows = order[at : at + BATCH].tolist()
        x = np.zeros((len(rows), lengths[rows[-1]]), np.uint8)
        for i, r in enumerate(rows):
            x[i, : lengths[r]] = signs[cuts[r, 0] : cuts[r, 1]]
        found = tagger.scores(np.ascontiguousarray(x.T))
        got = np.empty(found.shape[::-1], found.dtype)
        for t in range(0, len(found), BLOCK):
            got[:, :, t : t + BLOCK] = found[t : t + BLOCK].transpose(2, 1, 0)
        for part, r in zip(got, rows, strict=True):
            a, b, first = cuts[r].tolist()
            part = part[:, : b - a]
            if not first:
                part[:, :OVERLAP] *= rise
            if not begins[r + 1]:
                part[:, -OVERLAP:] *= rise[::-1]
            out[:, a:b] += part
    return out


def tag(tagger, codes: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Tags of all signs: the best path over each whole span (start, end), from the merged scores of its windows.

    A span's first and last sign count as outside. Where nothing around a sign speaks
    for a tag (Tagger.open_places), the best path is outside; there it is cut without
    changing it, and only the pieces between such places are left to Viterbi.
    """
    merged, tags = scores(tagger, codes, windows(spans)), np.zeros(len(codes), np.int8)
    if not len(codes):
        return tags
    inside = np.zeros(len(codes) + 1, bool)
    for a, b in spans.tolist():
        inside[a:b] = True
        merged[1:, a : a + 1] = merged[1:, max(a, b - 1) : b] = FAR
    merged[1:, np.flatnonzero(~inside[:-1])] = FAR
    open_ = tagger.open_places(merged) & inside[:-1]
    edge = np.diff(np.concatenate([[0], open_.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return tags
    # with one sign of the outside on either side, where the span has one; texts have a sign between them
    low, high = starts - ((starts > 0) & inside[starts - 1]), ends + inside[ends]
    merged[1:, low[low < starts]] = merged[1:, ends[high > ends]] = FAR
    for place, mine in _batches(np.stack([low, high], 1), 4096):
        best = tagger.viterbi(np.ascontiguousarray(merged.take(np.minimum(place, len(codes) - 1), 1).transpose(1, 0, 2)), ~mine)
        tags[place[mine]] = best[mine]
    return tags


def _batches(spans: np.ndarray, batch: int):
    """(places (T, B), which of them lie inside) of spans of like length."""
    lengths = spans[:, 1] - spans[:, 0]
    order, at = np.argsort(lengths, kind="stable"), 0
    while at < len(order):
        most = 8 + lengths[order[at]] * 5 // 4
        rows = order[at : at + batch]
        rows = rows[lengths[rows] <= most]
        place = spans[rows, 0] + np.arange(int(lengths[rows[-1]]))[:, None]
        yield place, place < spans[rows, 1]
        at += len(rows)


def runs(tags: np.ndarray) -> np.ndarray:
    """(start, end, tag) of the stretches of one tag other than 0."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], tags, [0]])))
    out = [(a, b, tags[a]) for a, b in zip(edge[:-1], edge[1:], strict=True) if tags[a]]
    return np.array(out, np.int64).reshape(-1, 3)
