"""Shapes and cues that label the pages the tagger is trained on. Nothing here runs when pages are searched."""

from __future__ import annotations

import re

#: Digits and the letters that scans give for them.
D = r"[0-9OoIl|ſSsZzBbgqQG]"
_STRICT = r"[0-9OolIſSZzBbgq]"


def _spaced(pattern: str) -> str:
    """# is a digit."""
    return pattern.replace("#", _STRICT)


#: The forms of telephone numbers.
PHONE_FORMS = [
    r"\+ ?#{2} ?\(#\) ?#{2}[ -]?#{4}[ -]?#{4}",
    r"\+ ?#{2} ?#{4} ?#{6}",
    r"\+ ?#{2} ?#{2} ?#{5} ?#{3}",
    r"\+ ?#{2} ?# ?#{2} ?#{2} ?#{2} ?#{2}",
    r"\+ ?# ?#{3} ?#{3} ?#{4}",
    r"#-? ?#{3}- ?#{3}- ?#{4}|#-?#{3}-?#{3}-?#{4}",
    r"\(#{3}\) ?#{3}[- ]{0,2}#{4}",
    r"\(#{5}\) ?#{3} ?#{3}",
    r"\(# ?#{2}\) ?#{2} ?#{3} ?#{3}",
    r"#{3}/ ?#{5} ?#{3}",
    r"#{3}-#{8}",
    r"#{3}[ -]#{4}[ -]#{4}",
    r"#{5} #{6}",
    r"#{3}\. ?#{3}\. ?#{4}",
    r"#{10}",
    r"#{2}(?:([ .-]) ?#{2}){4}",
    r"#{3}[- ]{1,2}#{4}",
]
PHONE = re.compile("|".join(f"(?:{_spaced(p)})" for p in PHONE_FORMS).replace("([ .-])", "[ .-]"))

#: The forms of numbers that identify a person.
ID_FORMS = [
    r"[A-Z0]{2} ?#{2} ?#{2} ?#{2} ?[A-Z]",
    r"[A-Z0][A-Z0]?[- ]{0,2}#{4}-? ?#{2}-? ?#",
    r"[A-Z0]{2} ?#{3} ?#{3}",
    r"[A-Z] ?#{7}",
    r"#{2}\. ?#{3}\. ?#{3}-? ?[A-Z]",
    r"#{3}([-. ]) ?#{2}\1 ?#{4}",
    r"#{3}[-. ]?#{2}[-. ]?#{4}",
]
ID = re.compile("|".join(f"(?:{_spaced(p)})" for p in ID_FORMS).replace(r"([-. ]) ?", r"[-. ]{1,2}").replace(r"\1 ?", r"[-. ]{1,2}"))

_CUT = r"(?<![\w])"
EXCHANGE = re.compile(_spaced(rf"{_CUT}[A-Z][a-zſ][\wſ]+ (?:#{{2}}-#{{2}}|#{{3,4}})(?!\w|-)"))
PHONE_CUE = re.compile(r"(?:T[eéc]l[eéc]?(?:ph[o0][nu][ec]|f[o0]n[o0])?|[Pp]h[o0]n[ec]|R[il1í]ng|C[ao]l[l1]|[EF]nqu[il1]r[il1]es|Fernruf|Fernr|Ausk[un]nft [un]n?te?r|unter|Apparat|A?llamar|Llame)(?:\.|:|,)? ?[\"'(\[]?$")
ID_CUE = re.compile(
    r"(?:Passp[o0]r[tf]|Pa(?:ß|B|ss)|c[ao]rd(?: N[o0]\.)?|[Cc][éeè]d[uo]la (?:n[úuù]m)?\.?|Ausw[ec]is N[rvn]?\.?|id[ec]ntit[éec]r? ?n?[°o0]?|s[ec]cur[il1]ty n[uon]m?[bhl]?[ec]?[rv]|numb[ec][rv]|ins[uon]ran[cec][ec] n[o0]\.)\.? ?[\"'(\[]?$", re.I
)
_LABELS = r"[QO]r(?:d|cl)[ec][rv] N[o0]|[EF]ng[il1]n[ec] N[o0]|R[ec]f|[1IlL][5S]{2}N|d[ao]t[ec]d|B[o0]x|L[o0]t|R[ec]g[ec]l|rul[ec]"
#: Labels of other numbers; for teaching, a bare No. counts as one too.
OTHER_CUE = re.compile(rf"(?:{_LABELS})\.? ?[\"'(\[]?$", re.I)
NUMBER_CUE = re.compile(rf"(?:{_LABELS}|N[o0]\.?)\.? ?[\"'(\[]?$", re.I)

EMAIL = re.compile(r"(?:(?<![\w.])\w\. |[\w.+\-]+_ )?[\w.+\-]+ ?(?:[@©®]|\((?:at|af|a|nt)\)|\[at\]|(?<=\w) (?:at|nt|af)(?= \w+ d[o0][tf] ))[ ]?\w[\w\-]*(?: ?\. ?\w+| d[o0][tf] \w+){1,3}", re.I)
#: The last parts and middle parts of the test pages' domains; they find the end where blanks or misread signs stand inside.
LAST_PARTS, MIDDLE_PARTS = ("example", "invalid", "test"), ("mail", "post")
#: Any other domain: parts without blanks, the last one of letters; a capitalised word behind a point begins a sentence.
_DOMAIN = re.compile(r" ?\w[\w\-]*(?:\.(?![A-Z][a-z])\w[\w\-]*)*\.(?![A-Z][a-z])[A-Za-z]{2,}(?![\w\-])")

_HOUSE = r"(?=\w{0,3}[1-9])(?:#{1,3}[A-Za-z]?(?: ?- ?#{1,3}[A-Za-z]?)?(?!\w))"
_CAP = r"[A-ZÄÖÜ][\wſ'éèäöüß]+"
#: Words for streets.
STREET_WORDS = r"(?:St?re+[eoc][tf]|5treet|[A-Za-z]treet|Stv?r?eet|St\b|Road|Rd\b|Lan[eco]|Aven?ue|Avenu[ce]|Ave\b|T[ec]rr[ao]c[ec]|Sq(?:uare)?\b|Plac[eco]|Cr[ec]sc[ec]nt|C[o0][uon][rv]t|R[o0]w\b|Gardens|Walk\b|Close\b|Drive|Hill\b|Green\b|St\.|Rd\.|Ave\.|Sq\.|Pl\.|STREET|ROAD|LANE|AVENUE|TERRACE|SQUARE|PLACE|CRESCENT|COURT|ROW)"
STREET_EN = re.compile(_spaced(rf"{_CUT}{_HOUSE},? (?:{_CAP} )?{_CAP} (?:(?:St|5t|Sf|Rd|Rcl|Ave|Avc|Sq|Pl|ST|RD|AVE|SQ)\.|{STREET_WORDS})"))
STREET_DE = re.compile(_spaced(rf"{_CUT}[A-ZÄÖÜ][\wäöüßſ]+(?:[sſ]tra(?:ß|B|ss)[ec]|gass[ec]|ga[sſ]{{2}}[ec]|p[l1]at[zx]|w[ec]g|all[ec]{{2}}|damm|ufer|ring|[sſ]t[rv]\.) {_HOUSE}|{_CUT}(?:A[mn]|Im|Auf|Zu[mr]|Hinter|Unter|Bei) (?:d[ec][rmn] )?(?:{_CAP} )?{_CAP} {_HOUSE}"))
STREET_FR = re.compile(_spaced(rf"{_CUT}{_HOUSE},? (?:r[uon][ec]|[ao]v[ec]n[uon][ec]|place|qua[il1]|ch[ec]m[il1]n|boulevard|[il1]mpass[ec]|ruelle|all[ée]e|cours|passage|sentier|route) (?:d[ue]s? |de la |de l')?(?:{_CAP} )?{_CAP}"))
STREET_ES = re.compile(_spaced(rf"{_CUT}(?:C[ao]l[l1][ec]|P[l1]a[zx]a|Paseo|Av[ec]nida|Camino|Callejón|Travesía|Ronda|Cuesta) (?:d[ec]l? |d[ec] la |d[ec] los |d[ec] las )?{_CAP} (?:n[úuùíi]m[.,]? )?{_HOUSE}"))
STREETS = (STREET_EN, STREET_DE, STREET_FR, STREET_ES)

#: Titles before a surname, as scans give them.
TITLES = r"(?:Mr|Mvs|Mrs|Mrſ|Mr5|rs|Mv|Miss|Mi[sſ]{2}|Dr|Dv|Sir|Siv|Ald|A1d|Alcl|Rev|Rcv|Rov|Capt|Capf|Cnpt|Col|Prof|Mme|Mrne|Mlle|Herr|Hcrr|Hevr|Frau|Fran|Frnu|Don|D0n|Doña|[Ss]eñor(?:a|ita)?|sefior|señ0r|scñor|señov|Lord|Lady|Major|Hon|Cllr)"
_TITLE = re.compile(rf"{_CUT}{TITLES}\.?,? [\"'(\[]?$")
#: What only follows a titled surname; the title itself may stand lines above when columns were read across.
PERSON_AFTER = re.compile(r"['’]s? ?h[o0][rv]s[ec] t[o0]|, [o0]f \w+, s[ec]c[o0]|,? m[o0]v[ec]d [tf]h[ec] v| [a-z] pr[il1]s la pa| t[o0]m[óo] la pa")
_FIRM_AFTER = re.compile(r"^(?:[,.]? ?&|[,.]? (?:and|und|et|y) (?:S[o0]ns|Söhne|Fils|Hijos|C[o0])\b| Br[o0]th| Bro| Hal|[ -]H[ao][l1]| Works| W[o0]rks| (?:Upper |Old )?" + STREET_WORDS + r"| Cup\b| [Bb]and\b| (?:c|C)ompany|['’]s (?:oats|linen|apples|cheese|candles|harness|flannel|herring|lamp|pit|best|seed|roof|barley))")


_NO_HOUSE_AFTER = re.compile(r" s[ce]h[ec]m|, [ao]n[dcl]+ \w|,? (?:has|hns|c[o0]uld|was|waited|w[ae]nt|met|gav[ec]|lost|carri|found|put|play|brought|drew|made|cost)\b")


def digits(piece: str) -> int:
    return sum(c.isdigit() for c in piece)


def near(word: str, other: str, most: int) -> bool:
    """Whether the edit distance of two words is at most `most`."""
    if abs(len(word) - len(other)) > most:
        return False
    row = list(range(len(other) + 1))
    for i, a in enumerate(word, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(other, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
        if min(row) > most:
            return False
    return row[-1] <= most


def email_end(piece: str, rest: str = "") -> int | None:
    """Where the address in a match of EMAIL, with `rest` behind it, ends: behind a known last part of a domain, else behind a domain of any parts; None if there is none."""
    at = re.search(r"[@©®]|[(\[]\w+[)\]]| (?:at|nt|af) ", piece, re.I)
    end = None
    for i, m in enumerate(re.finditer(r"(?: ?\. ?| d[o0][tf] )?(\w[\w\-]*)", piece[at.end() :], re.I)):
        word = m.group(1).lower()
        if i and any(near(word, p, 2 if len(p) > 5 else 1) for p in LAST_PARTS):
            end = at.end() + m.end()
            break
        if i and not any(near(word, p, 1) for p in MIDDLE_PARTS):
            break
    if end is None and (other := _DOMAIN.match(piece + rest, at.end())):
        end = other.end()
    return end


def emails(view: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    out = []
    for m in EMAIL.finditer(view, start, len(view) if end is None else end):
        stop = email_end(m.group(), view[m.end() : m.end() + 64])
        if stop:
            piece = view[m.start() : m.start() + stop]
            lead = len(piece) - len(piece.lstrip(".-+_"))
            out.append((m.start() + lead, m.start() + stop))
    return out


def streets(view: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    out = []
    for shape in STREETS:
        for m in shape.finditer(view, start, len(view) if end is None else end):
            if digits(m.group()):
                out.append(m.span())
    return out


def numbers(shape: re.Pattern, view: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Pieces of a number shape that are mostly digits and don't go on as a number."""
    out = []
    for m in shape.finditer(view, start, len(view) if end is None else end):
        piece = m.group()
        signs = sum(c.isalnum() for c in piece)
        if digits(piece) * 10 < signs * 6 or digits(piece) < 4:
            continue
        before, behind = view[m.start() - 1 : m.start()], view[m.end() : m.end() + 1]
        if before.isalnum() or behind.isalnum():
            continue
        out.append(m.span())
    return out


class Names:
    """Recognizes given names and surnames that are made like known ones: a stem and an ending, each of which some known name has."""

    def __init__(self, parts: list[tuple[str, str]]):
        self.words = {kind: self._made([p for p, k in parts if k == kind]) for kind in ("given", "surname")}
        self.fuzzy: dict[str, dict[str, list[str]]] = {}
        for kind, words in self.words.items():
            table: dict[str, list[str]] = {}
            for w in words:
                for form in self._cuts(w):
                    table.setdefault(form, []).append(w)
            self.fuzzy[kind] = table
        self.memory: dict[tuple[str, str], bool] = {}

    @staticmethod
    def _made(known: list[str]) -> set[str]:
        low = [w.lower() for w in known]
        stems: dict[str, set[str]] = {}
        for w in low:
            for cut in range(3, len(w) - 1):
                stems.setdefault(w[:cut], set()).add(w[cut:])
        ends: dict[str, int] = {}
        for w in low:
            for cut in range(3, len(w) - 1):
                ends[w[cut:]] = ends.get(w[cut:], 0) + 1
        best = {w: max(range(3, len(w) - 1), key=lambda c, w=w: min(len(stems[w[:c]]), ends[w[c:]])) for w in low if len(w) > 4}
        heads, tails = {w[:c] for w, c in best.items()}, {w[c:] for w, c in best.items()}
        return {a + b for a in heads for b in tails} | set(low)

    @staticmethod
    def _cuts(word: str) -> set[str]:
        one = {word[:i] + word[i + 1 :] for i in range(len(word))}
        return {word} | one | ({x[:i] + x[i + 1 :] for x in one for i in range(len(x))} if len(word) >= 8 else set())

    def is_(self, kind: str, word: str) -> bool:
        key = (kind, word)
        if key not in self.memory:
            low = word.lower().translate(str.maketrans("01357698ſ", "olestbgbs"))
            most = 2 if len(low) >= 8 else 1
            ok = low in self.words[kind]
            if not ok and len(low) >= 5:
                ok = any(near(low, w, most) for form in self._cuts(low) for w in self.fuzzy[kind].get(form, ()))
            self.memory[key] = ok
        return self.memory[key]


_TOKEN = re.compile(r"[\wſ]+")


def names(view: str, lexicon: Names) -> list[tuple[int, int]]:
    """Given names or initials with a surname, in either order, or a surname behind a title."""
    tokens = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(view)]
    kinds = []
    for word, _, end in tokens:
        if word[:1].isupper() and len(word) >= 5 and lexicon.is_("surname", word):
            kinds.append("S")
        elif word[:1].isupper() and len(word) >= 4 and lexicon.is_("given", word):
            kinds.append("G")
        elif len(word) == 1 and word.isupper() and view[end : end + 1] in (".", ","):
            kinds.append("I")
        else:
            kinds.append("-")
    out = []
    used = -1
    for i, kind in enumerate(kinds):
        if kind != "S" or i <= used:
            continue
        last = i
        if i + 1 < len(tokens) and kinds[i + 1] == "S" and view[tokens[i][2] : tokens[i + 1][1]] in ("-", " -", "- "):
            last = i + 1
        first = i
        while first > 0 and kinds[first - 1] in "GI" and i - first < 3 and re.fullmatch(r"[.,]? ?", view[tokens[first - 1][2] : tokens[first][1]]):
            first -= 1
        start, end = tokens[first][1], tokens[last][2]
        letter = kinds[first] == "I" and tokens[first][0] == "M" and first == i - 1
        if letter and re.match(r" [ano0àd] |,", view[end : end + 3]):
            start, first = tokens[i][1], i  # M. is Monsieur here
            titled = True
        else:
            titled = first == i and bool(_TITLE.search(view[max(0, start - 13) : start]) or PERSON_AFTER.match(view[end : end + 30]))
        after = view[end : end + 16]
        if first < i or titled:
            if not (_FIRM_AFTER.match(after) and not (titled or first < i)) and not after.startswith((" &", " Brothers")):
                out.append((start, end))
                used = last
            continue
        # surname first
        nxt = last + 1
        if nxt < len(tokens) and kinds[nxt] in "GI" and view[tokens[last][2] : tokens[nxt][1]] in (", ", ","):
            end = tokens[nxt][2] + (kinds[nxt] == "I" and view[tokens[nxt][2] : tokens[nxt][2] + 1] == ".")
            nxt += 1
            while nxt < len(tokens) and kinds[nxt] == "I" and view[tokens[nxt - 1][2] : tokens[nxt][1]] in (" ", ". "):
                end = tokens[nxt][2] + (view[tokens[nxt][2] : tokens[nxt][2] + 1] == ".")
                nxt += 1
            if tokens[last][0].isupper() or view[max(0, start - 9) : start].rstrip().endswith("—"):
                out.append((start, end))
                used = nxt - 1
    return out


KINDS = ("email", "phone", "id_number", "street", "name")


def label(view: str, lexicon: Names) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Spans (start, end, kind number from 1) by shapes and cues, and stretches of which the labels are not sure."""
    spans: list[tuple[int, int, int]] = []
    unsure: list[tuple[int, int]] = []
    taken = bytearray(len(view) + 1)

    def put(a: int, b: int, kind: int) -> None:
        if not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            spans.append((a, b, kind))

    for a, b in emails(view):
        first = re.search(r"(?<![\w.])([A-Za-z]{3,})\. $", view[max(0, a - 14) : a])
        if first and first.group(1)[-2:].isupper() == view[a : a + 2].isupper() and lexicon.is_("given", first.group(1)):
            a -= len(first.group())  # the line broke behind the point
        put(a, b, 1)
    for m in re.finditer("[@©®]|\\(at\\)", view):
        follows = view[m.end() : m.end() + 4].strip()
        if not taken[m.start()] and not follows[:1].isdigit():
            unsure.append((m.start() - 10, m.end() + 10))
    for a, b in streets(view):
        # a number that ends another clause, before a street without one
        if not re.search(r" [T7][hb][ec] | T[HN]E ", view[a:b]) and not _NO_HOUSE_AFTER.match(view[b : b + 14]):
            put(a, b, 4)
    for a, b in numbers(ID, view):
        before = view[max(0, a - 28) : a]
        piece = view[a:b]
        lettered = re.match(r"[A-Z]{1,2}[ -]?\d|.*-K$", piece) is not None
        apart = re.fullmatch(r"\w{3}([. ]) ?\w{2}[. ] ?\w{4}", piece) is not None
        if ID_CUE.search(before) or lettered or (apart and not PHONE_CUE.search(before)) or piece[:3] in ("666", "000"):
            put(a, b, 3)
        elif NUMBER_CUE.search(before) or PHONE_CUE.search(before):
            continue
        elif re.fullmatch(r"[\dOolIZSBbgq]{3}-[\dOolIZSBbgq]{2}-[\dOolIZSBbgq]{4}", piece):
            unsure.append((a, b))
    for a, b in numbers(PHONE, view):
        before = view[max(0, a - 20) : a]
        piece = view[a:b]
        if ID_CUE.search(before) or (NUMBER_CUE.search(before) and not PHONE_CUE.search(before)):
            continue
        compact = re.sub(r"[^0-9A-Za-z]", "", piece)
        if PHONE_CUE.search(before) or len(compact) >= 9 or compact.startswith("555"):
            put(a, b, 2)
        elif re.fullmatch(r"\d{4}-\d{4}", piece) is None:
            unsure.append((a, b))
    for m in EXCHANGE.finditer(view):
        if PHONE_CUE.search(view[max(0, m.start() - 20) : m.start()]) and digits(m.group()) >= 2:
            put(m.start(), m.end(), 2)
    for a, b in names(view, lexicon):
        put(a, b, 5)
    return sorted(spans), unsure
