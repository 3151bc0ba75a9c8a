"""Made-up personal data for training: other names, domains, numbers and sentences than those of any page.

The tagger should learn what an address or a name looks like and not which ones
the pages have, so labelled spans are filled anew, and ordinary sentences in four
languages are added whose spans are known because they were put there.
"""

from __future__ import annotations

import re

import numpy as np

from millrace.llm.personal import KINDS

GIVEN = (
    "Anna Maria Peter John Mary James Linda Robert Susan Michael Karen David Nancy Thomas Laura Daniel Emma Olivia Liam Noah Priya Arjun Anjali Rahul Wei Ming Hiroshi Yuki Akiko Kenji Olumide Chinwe Amara Kwame Fatima Ahmed Leila Omar Yusuf "
    "Aisha Carlos Lucía José Carmen Javier Sofía Diego Pilar Jean Pierre Claire Amélie Luc Camille Hélène François Hans Greta Jürgen Heinrich Ursula Wolfgang Björn Ingrid Lars Astrid Giulia Marco Paolo Chiara Ivan Olga Dmitri Natasha Jan Katarzyna Piotr Zofia Mehmet Elif"
).split()
SURNAMES = (
    "Smith Jones Brown Taylor Wilson Johnson Lee Martin Clark Walker Hall Young King Wright Green Baker Adams Nelson Carter Mitchell Raghunathan Sharma Patel Gupta Chen Wang Li Zhang Tanaka Suzuki Sato Nakamura Adeyemi Okafor Mensah Diallo Hassan Khan Hussein Ali "
    "García Fernández López Martínez Sánchez Pérez Gómez Ruiz Dubois Durand Lefèvre Moreau Laurent Girard Rousseau Müller Schmidt Schneider Fischer Weber Becker Hoffmann Schäfer Koch Larsen Nilsson Johansson Rossi Ferrari Bianchi Romano Petrov Ivanova Kowalski Nowak Yılmaz Demir O'Brien O'Connor McDonald MacLeod"
).split()
TITLES = "Mr. Mrs. Ms. Miss Dr. Prof. Professor Captain Capt. Colonel Major Sir Lady Lord Madame Mme Mlle Monsieur Herr Frau Señor Señora Don Doña Alderman Councillor Rev. Father Sister Inspector Sergeant Judge Senator Doctor Nurse Uncle Aunt".split()
TOWNS = "Leeds Boston Lyon Köln Sevilla Denver Bristol Nantes Bremen Toledo Austin Dover Ashton Tours Kiel".split()
STREETS_EN = "Street Road Lane Avenue Drive Court Place Square Terrace Crescent Way Boulevard Close Row St. Rd. Ave. Dr. Ln. Sq. Pl. Blvd. St Rd Ave Dr".split()
STREETS_DE = "straße gasse weg platz allee str. ring damm ufer".split()
STREETS_FR = "rue avenue boulevard place quai chemin impasse allée".split()
STREETS_ES = "Calle Plaza Avenida Paseo Camino Ronda".split()
ENDS = "com org net edu gov io co.uk ac.uk de fr es it nl ch at eu info biz com.au ca jp example invalid test".split()
BOXES = "info contact sales office mail post hello support admin jobs press kontakt service team news".split()
SYLLABLES = "ba be bo da de di do fa fe ga ge go ha he ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe po ra re ri ro sa se si so ta te ti to va ve vi wa we za zo chi sho tre bra cla gri kra sto".split()
TAILS = "n r l s t d m nd rt ck ll n nson ley ton berg mann ski ez er in a o y".split()

#: {k} stands for a span of its kind, {t} for a title, {o} for a town, {w} for a made word, {#} for a number.
SENTENCES = (
    "Her SSN is {id_number}. | His social security number is {id_number}, she said. | Passport {id_number} was found near the station. | Please quote insurance number {id_number} when you write. | ID card no. {id_number} belongs to {name}. | The card number {id_number} has expired. | "
    "Contact {name} at {phone}. | You can reach {name} on {phone} after six. | Call {phone} or write to {email}. | Tel. {phone} | Phone: {phone}, fax: {phone}. | Mail {email} for details. | Send your answer to {email}, please. | My address is {email} and my number {phone}. | Write to {email}. The office is closed on Monday. | "
    "{name} lives at {street} in {o}. | The house at {street} was sold. | {name} and {name} were married in {o}. | We met {t} {surname} at the market. | {t} {surname} and {t} {surname} spoke first. | The report was written by {name}, {name} and {name}. | {surname_first} was present. | Dear {t} {surname}, thank you for the letter. | "
    "According to {name}, the meeting was short. | {name} said so on Tuesday. | It was {name} who opened the door. | The winner was {name} of {o}. | Deliver it to {street}, {o}. | He moved from {street} to {street}. | Our shop is at {street}. | {name}, {street}, {o}, {phone}, {email} | "
    "Herr {surname} wohnt {street_de}. | {name} wurde in {o} geboren. | Frau {surname} ist unter {phone} zu erreichen. | Bitte schreiben Sie an {email}. | Die Wohnung {street_de} ist frei. | Ausweis Nr. {id_number} wurde gefunden. | Der Preis ging an {name}. | "
    "{name} habite {street_fr} à {o}. | Écrivez à {email}. | Téléphone : {phone}. | Madame {surname} est arrivée hier. | M. {surname} a parlé le premier. | La maison du {street_fr} est à vendre. | Carte d'identité {id_number} perdue. | "
    "{name} vive en {street_es}, {o}. | Llame al {phone}. | Escriba a {email}. | La señora {surname} llegó ayer. | El premio fue para {name}. | Cédula {id_number} extraviada. | La casa de {street_es} se vende. | "
    "Order No. {#}-{#}-{#} was shipped on Friday. | Engine no. {#} of the {w} works. | In {#} there were {#} people in {o}. | The train leaves at {#}.{#} from {o}. | {w} & Sons have sold the {w} Hall. | The {w} Company of {o} closed. | {w} Street was closed for {#} days. | See page {#} and rule {#}. | The price was ${#} or {#} per cent. | "
    "ISBN {#}-{#}-{#}-{#} | Invoice {#} of {#} March. | {o} beat {o} by {#} to {#}. | The {w} River rose {#} feet. | Visit www.{w}.com for more. | Eggs @ {#} per score. | On Monday the {w} Club met in {o}. | The old road from {o} to {o} is {#} miles long. | Version {#}.{#} was released. | The King of {o} and the Queen spoke. | "
    "New York, San Francisco and {o} were named. | United States, Great Britain, South {o} | The Grand Hotel in {o} has {#} rooms. | Ask for {w}'s soap. | The steamer {w} left {o}. | The Bank of {o} lent {#}. | Lot {#}, {#} acres near {o}. | Die Firma {w} in {o} hat {#} Arbeiter. | La maison {w} de {o} compte {#} ouvriers. | La casa {w} de {o} tiene {#} obreros. "
).split("|")

PHONES = ("+1 ### ### ####", "(###) ###-####", "###-###-####", "### ### ####", "###.###.####", "+44 20 #### ####", "0## #### ####", "0#### ######", "+49 ### #######", "0## ########", "+33 # ## ## ## ##", "0# ## ## ## ##", "+34 ### ### ###", "### ## ## ##", "1-800-###-####", "+## ## #### ####", "###-####", "(0##) ### ## ##", "0###/#######", "### ####", "+81 3-####-####")
IDS = ("###-##-####", "###-##-####", "### ## ####", "#########", "@@ ## ## ## @", "@@######@", "@########", "@@#######", "#### #### #### ####", "####-####-####-####", "########-@", "########@", "##.###.###-@", "# ## ## ## ### ### ##", "@## ######", "@@ ### ###", "@-#######")


class Maker:
    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def word(self) -> str:
        made = "".join(self.pick(SYLLABLES) for _ in range(int(self.rng.integers(1, 4)))) + self.pick(TAILS)
        return made.capitalize()

    def given(self) -> str:
        return self.pick(GIVEN) if self.chance(0.5) else self.word()

    def surname(self) -> str:
        made = self.pick(SURNAMES) if self.chance(0.4) else self.word()
        return f"{made}-{self.word()}" if self.chance(0.04) else made

    def name(self) -> str:
        first = [self.given()]
        if self.chance(0.25):
            first = [f"{self.pick('ABCDEFGHIJKLMNOPRSTVW')}." for _ in range(int(self.rng.integers(1, 3)))]
        elif self.chance(0.15):
            first.append(f"{self.pick('ABCDEFGHIJKLMNOPRSTVW')}.")
        made = " ".join([*first, self.surname()])
        return made.upper() if self.chance(0.05) else made

    def surname_first(self) -> str:
        return f"{self.surname()}, {self.given() if self.chance(0.5) else self.pick('ABCDEFGHJKLMPRSTW') + '.'}"

    def digits(self, form: str) -> str:
        return "".join(str(self.rng.integers(10)) if c == "#" else self.pick("ABCDEFGHJKLMNPRSTXYZ") if c == "@" else c for c in form)

    def number(self) -> str:
        return str(int(10 ** self.rng.uniform(0, 5)))

    def domain(self) -> str:
        return ".".join([*(self.word().lower() for _ in range(1 + self.chance(0.2))), self.pick(ENDS)]) if self.chance(0.9) else f"{self.word().lower()}-{self.word().lower()}.{self.pick(ENDS)}"

    def local(self) -> str:
        kind, one, two = int(self.rng.integers(6)), self.given().lower(), self.surname().lower().replace("'", "")
        return (self.pick(BOXES), one, f"{one}{self.pick('._-')}{two}", f"{one[0]}.{two}", f"{two}{self.number()}", f"{one}{two[0]}")[kind]

    def email(self) -> str:
        made = f"{self.local()}{self.pick(('@', '@', '@', '@', '©', '(at)'))}{self.domain()}"
        return made.upper() if self.chance(0.04) else made

    def phone(self) -> str:
        return self.digits(self.pick(PHONES))

    def id_number(self) -> str:
        return self.digits(self.pick(IDS))

    def house(self) -> str:
        return str(int(self.rng.integers(1, 300))) + (self.pick("abcAB") if self.chance(0.1) else "")

    def street(self) -> str:
        words = [self.pick(SURNAMES) if self.chance(0.3) else self.pick(("Elm", "Oak", "Main", "High", "Mill", "Park", "Church", "Station", "Queen", "West", "North")) if self.chance(0.5) else self.word()]
        if self.chance(0.15):
            words.insert(0, self.pick(("Old", "Upper", "East", "New", "Lower", "N.", "S.")))
        return f"{self.house()}{',' if self.chance(0.05) else ''} {' '.join(words)} {self.pick(STREETS_EN)}"

    def street_de(self) -> str:
        return f"{self.word()}{self.pick(STREETS_DE)} {self.house()}" if self.chance(0.8) else f"{self.pick(('Am', 'Im', 'An der', 'Auf dem', 'Zum'))} {self.word()} {self.house()}"

    def street_fr(self) -> str:
        return f"{self.house()}{',' if self.chance(0.4) else ''} {self.pick(STREETS_FR)} {self.pick(('', 'de la ', 'du ', 'des ', 'de '))}{self.word()}"

    def street_es(self) -> str:
        return f"{self.pick(STREETS_ES)} {self.pick(('', 'de la ', 'del ', 'de '))}{self.word()}{self.pick((' ', ', ', ' núm. '))}{self.house()}"

    def sentence(self) -> tuple[str, list[tuple[int, int, int]]]:
        """A sentence and its spans (start, end, kind number)."""
        text, spans = "", []
        for i, piece in enumerate(re.split(r"\{([a-z_#]+)\}", self.pick(SENTENCES).strip())):
            if i % 2 == 0:
                text += piece[1:] if text.endswith(".") and piece.startswith(".") else piece  # one point ends both
                continue
            if piece in "tow#":
                text += {"t": lambda: self.pick(TITLES), "o": lambda: self.pick(TOWNS) if self.chance(0.5) else self.word(), "w": self.word, "#": self.number}[piece]()
                continue
            filled = getattr(self, piece)()
            kind = KINDS.index(piece.partition("_")[0] if piece.startswith("street") else "name" if piece.startswith("surname") else piece) + 1
            spans.append((len(text), len(text) + len(filled), kind))
            text += filled
        return text, spans

    def paragraph(self, length: int) -> tuple[str, np.ndarray]:
        """About `length` signs of sentences, and their tags."""
        text, tags = [], []
        while sum(map(len, text)) < length:
            words, spans = self.sentence()
            mark = np.zeros(len(words) + 1, np.int8)
            for a, b, kind in spans:
                mark[a:b] = kind
            text.append(words + " ")
            tags.append(mark)
        return "".join(text), np.concatenate(tags)

    # ---- spans of pages, filled anew

    def other(self, piece: str, kind: str) -> str:
        """Another span in the form of this one."""
        if kind in ("phone", "id_number"):
            return "".join(str(self.rng.integers(10)) if c.isdigit() and i else c for i, c in enumerate(piece))
        if kind == "email":
            found = re.search(r" ?[@©®] ?|\(at\)|\[at\]| at ", piece, re.I)
            if not found:
                return piece
            made = f"{self.local()}{found.group()}{self.domain()}"
            return made.upper() if piece.isupper() else made
        if kind == "name":
            return re.sub(r"[^\W\d_]+", lambda m: self._as(m.group()), piece)
        words = list(re.finditer(r"[A-ZÄÖÜ][a-zäöüßéè]{2,}(?= )", piece))
        if kind == "street" and words and re.match(r"\d", piece):
            m = words[0]
            return piece[: m.start()] + self.word() + piece[m.end() :]
        return piece

    def _as(self, word: str) -> str:
        if len(word) == 1:
            return self.pick("ABCDEFGHJKLMPRSTW")
        if len(word) == 2:
            return word
        made = self.given() if self.chance(0.5) else self.surname()
        return made.upper() if word.isupper() else made

    def refilled(self, view: str, tags: np.ndarray, runs) -> tuple[str, np.ndarray]:
        """The page with other spans in the places of its own."""
        text, mark, at = [], [], 0
        for a, b, kind in runs:
            made = self.other(view[a:b], KINDS[kind - 1])
            text += [view[at:a], made]
            mark += [tags[at:a], np.full(len(made), kind, np.int8)]
            at = b
        text.append(view[at:])
        mark.append(tags[at:])
        return "".join(text), np.concatenate(mark)
