"""Trains the tagger of personal data and writes its weights.

    python -m millrace.llm.train_personal DIRECTORY WEIGHTS [PROCESSES]

reads documents and known_name of the directory. Labelled spans come from shapes
and cues (shapes.label) on the first PAGES pages by id, a documented bound; from
copies of these pages in which the labelled spans are filled anew with other names,
domains and numbers (made.Maker); and from ordinary sentences whose spans are known
because they were put there. Some copies get more misread, lost and added signs, with
the labels kept; some names come in capitals too. Windows of whose labels the
shapes aren't sure are left out. Pages whose id is divisible by HELD_OUT are kept
out and give the accuracy.
"""

from __future__ import annotations

import sys
import time
from multiprocessing import get_context

import numpy as np
import pyarrow.parquet as pq

from millrace.llm import pages, personal, shapes
from millrace.llm.made import Maker
from millrace.llm.tagger import Tagger

PAGES, HELD_OUT, HIDDEN, EPOCHS = 9000, 11, 24, 9
#: Copies of a page with spans filled anew: plain, and spoilt.
REFILLED, SPOILT = 1, 1
#: More copies of windows with rare forms.
RARE = 2
#: Share of windows with names that come in capitals too.
CAPITALS = 0.15
#: Share of pages to which a paragraph of made sentences is added as a window of its own.
MADE = 1.0

#: How scans misread signs.
MISREAD = {
    "o": "0c", "O": "0Q", "0": "Oo", "l": "1I", "I": "1lL", "1": "lI", "e": "co", "c": "eo", "h": "bln", "n": "ur", "u": "nv", "s": "ſ5", "S": "5", "5": "S", "t": "fl", "f": "ſt", "r": "vi", "v": "ry",
    "a": "no", "d": "cl", "m": "nrn", "g": "q9", "9": "gq", "b": "h6", "6": "b", "B": "8R", "8": "B3", "2": "Z", "Z": "2", "T": "7", "y": "vg", "i": "íl1", "E": "FC", "w": "vv", "q": "g", ".": ",", ",": ".", "@": "©", "3": "8",
}


def spoil(view: str, tags: np.ndarray, rate: float, rng: np.random.Generator) -> tuple[str, np.ndarray]:
    """A worse scan of the same piece; the tags go along."""
    out, kept = [], []
    for c, tag, chance in zip(view, tags, rng.random(len(view)), strict=True):
        if chance < rate and c in MISREAD:
            for other in {0: MISREAD[c][0], 1: MISREAD[c][-1]}[int(rng.integers(2))]:
                out.append(other)
                kept.append(tag)
        elif chance < rate * 1.25:
            continue
        else:
            out.append(c)
            kept.append(tag)
            if chance > 1 - rate / 10 and c.isalnum():
                out.append("' .-"[int(rng.integers(4))])
                kept.append(tag)
    return "".join(out), np.array(kept, np.int8)


def _rare(view: str, tags: np.ndarray) -> bool:
    """Whether the piece has a street that isn't English, or an exchange by name."""
    found = "".join(c if t in (2, 4) else " " for c, t in zip(view, tags, strict=True))
    return any(shape.search(found) for shape in (*shapes.STREETS[1:], shapes.EXCHANGE))


def labelled(view: str, lexicon: shapes.Names) -> tuple[np.ndarray, np.ndarray]:
    """Tags of a page and where they are doubtful."""
    spans, unsure = shapes.label(view, lexicon)
    tags, doubt = np.zeros(len(view), np.int8), np.zeros(len(view), bool)
    for a, b, kind in spans:
        tags[a:b] = kind
    for a, b in unsure:
        doubt[max(0, a) : b] = True
    return tags, doubt


#: Length of the windows to train on.
LENGTH = 320


def _cut(view: str, tags: np.ndarray, doubt: np.ndarray | None, shift: int, only_spans: bool = False):
    """Windows (signs, tags) of a page; the first has `shift` signs less."""
    view = personal.BEFORE + view + personal.BEHIND
    tags = np.concatenate([np.zeros(len(personal.BEFORE), np.int8), tags, np.zeros(len(personal.BEHIND), np.int8)])
    if doubt is not None:
        doubt = np.concatenate([np.zeros(len(personal.BEFORE), bool), doubt, np.zeros(len(personal.BEHIND), bool)])
    codes = pages.encode(pages.points(view))
    first = max(1, LENGTH - shift)
    ends = [0, *range(first, len(view), LENGTH), len(view)]
    for a, b in zip(ends, ends[1:], strict=False):
        if b > a and not (doubt is not None and doubt[a:b].any()) and not (only_spans and not tags[a:b].any()):
            yield codes[a:b], tags[a:b]


def _page(job: tuple[int, str]) -> list[tuple[np.ndarray, np.ndarray]]:
    number, text = job
    rng, maker, out = np.random.default_rng(number), Maker(number + 1_000_000), []
    view, _ = pages.clean(text)
    if view:
        tags, doubt = labelled(view, _LEXICON)
        out += _cut(view, tags, doubt, int(rng.integers(LENGTH)))
        spans = pages.runs(tags).tolist()
        if spans:
            clear = [s for s in spans if not doubt[s[0] : s[1]].any()]
            copies = [(True, 0.0)] * REFILLED + [(True, 0.1)] * SPOILT + [(False, 0.1)] * SPOILT
            if _rare(view, tags):
                copies += [(True, 0.0), (False, 0.06)] * RARE
            for fresh, rate in copies:
                new, kept = maker.refilled(view, tags, clear) if fresh else (view, tags)
                if doubt.any():
                    continue
                if rate:
                    new, kept = spoil(new, kept, rate * rng.random(), rng)
                out += _cut(new, kept, None, int(rng.integers(LENGTH)), only_spans=True)
            if (tags == 5).any() and rng.random() < CAPITALS and not doubt.any():
                # names, or whole lines, in capitals are rare but there
                whole = rng.random() < 0.3
                loud = "".join(c.upper() if (whole or t == 5) and len(c.upper()) == 1 else c for c, t in zip(view, tags, strict=True))
                out += _cut(loud, tags, None, 0, only_spans=True)
    if rng.random() < MADE:
        new, kept = maker.paragraph(300)
        if rng.random() < 0.3:
            new, kept = spoil(new, kept, 0.04 * rng.random(), rng)
        out += _cut(new[:LENGTH], kept[:LENGTH], None, 0)
    return [(x.astype(np.uint8), y.astype(np.int8)) for x, y in out]


def _with(lexicon: shapes.Names) -> None:
    global _LEXICON
    _LEXICON = lexicon


def samples(texts: list[str], lexicon: shapes.Names, processes: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows (signs, tags) to train on."""
    jobs = list(enumerate(texts))
    if processes == 1:
        _with(lexicon)
        return [w for j in jobs for w in _page(j)]
    with get_context("fork").Pool(processes, _with, (lexicon,)) as pool:
        return [w for part in pool.imap(_page, jobs, 64) for w in part]


def accuracy(tagger: Tagger, texts: list[str], lexicon: shapes.Names) -> dict[str, tuple[float, float, int]]:
    """Precision, recall and number of exact spans by kind, against the shapes' labels."""
    right, found, wanted = np.zeros(6, int), np.zeros(6, int), np.zeros(6, int)
    views = [pages.clean(t)[0] for t in texts]
    for view, spans in zip(views, personal.spans(tagger, views), strict=True):
        tags, doubt = labelled(view, lexicon)
        got = {s for s in spans if not doubt[s[0] : s[1]].any()}
        for s in map(tuple, pages.runs(tags).tolist()):
            wanted[s[2]] += 1
            right[s[2]] += s in got
        for s in got:
            found[s[2]] += 1
    return {k: (round(right[i] / max(1, found[i]), 4), round(right[i] / max(1, wanted[i]), 4), int(wanted[i])) for i, k in enumerate(personal.KINDS, 1)}


def made_accuracy(tagger: Tagger, number: int = 2000, seed: int = 77) -> dict[str, tuple[float, float, int]]:
    """The same on made sentences that training hasn't seen."""
    maker = Maker(seed)
    right, found, wanted = np.zeros(6, int), np.zeros(6, int), np.zeros(6, int)
    made = [maker.sentence() for _ in range(number)]
    for (_, spans), got in zip(made, personal.spans(tagger, [t for t, _ in made]), strict=True):
        for s in spans:
            wanted[s[2]] += 1
            right[s[2]] += s in got
        for s in got:
            found[s[2]] += 1
    return {k: (round(right[i] / max(1, found[i]), 4), round(right[i] / max(1, wanted[i]), 4), int(wanted[i])) for i, k in enumerate(personal.KINDS, 1)}


def train(texts: list[str], lexicon: shapes.Names, hidden: int = HIDDEN, epochs: int = EPOCHS, batch: int = 256, processes: int = 1, say=None) -> Tagger:
    tagger = Tagger(pages.SIGNS, len(personal.KINDS), hidden)
    windows = samples(texts, lexicon, processes)
    if say:
        say(f"{len(windows)} windows, {sum(len(x) for x, _ in windows)} signs")
    tagger.fit(windows, epochs=epochs, batch=batch, workers=processes, say=say)
    return tagger


def main(directory: str, target: str, processes: str = "1") -> None:
    table = pq.read_table(f"{directory}/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id").to_pydict()
    rows = [(i, t) for i, t in zip(table["doc_id"], table["text"], strict=True) if t][:PAGES]
    names = pq.read_table(f"{directory}/known_name.parquet").to_pydict()
    lexicon = shapes.Names(list(zip(names["name_part"], names["part_kind"], strict=True)))
    learn, held = [t for i, t in rows if i % HELD_OUT], [t for i, t in rows if i % HELD_OUT == 0]
    began = time.time()
    tagger = train(learn, lexicon, processes=int(processes), say=lambda x: print(x, f"{time.time() - began:.0f} s", flush=True))
    tagger.save(target)
    print(accuracy(Tagger.load(target), held, lexicon))
    print(made_accuracy(Tagger.load(target)))


if __name__ == "__main__":
    main(*sys.argv[1:4])
