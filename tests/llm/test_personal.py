import numpy as np
import pyarrow.parquet as pq
import pytest

from millrace.llm import pages, personal, shapes, train_personal
from millrace.llm.tagger import Tagger

NAMES = [(a + b, "given") for a in ("Ard", "Bet", "Cel", "Dor") for b in ("ane", "ella", "ric", "wyn")] + [(a + b, "surname") for a in ("Bran", "Crav", "Drew", "Dunn") for b in ("brook", "quist", "stead", "wick")]


@pytest.fixture(scope="module")
def tagger():
    return Tagger.load(str(personal.WEIGHTS))


def found(tagger, text):
    return {(personal.KINDS[k - 1], text[a:b]) for a, b, k in personal.spans(tagger, [text])[0]}


CASES = [
    ("The vestry met on Monday. Write to betwyn.ketbrook@larkpost.test. The ferry was late.", {("email", "betwyn.ketbrook@larkpost.test")}),
    ("cheese @ 95/6, with few buyers. E-mail holloway53(at)silnet.mail.test The vestry", {("email", "holloway53(at)silnet.mail.test")}),
    ("Nothing over 415! Telephone +44 1632 960913. The tenants of Weir Street", {("phone", "+44 1632 960913")}),
    ("the mason agreed. Call 1-800-\n555-0131 or write. A party of 94 put the loss at", {("phone", "1-800-\n555-0131")}),
    ("The river stood at 20 feet. Lost, identity card No. QQ 03 05 27 C; finder please return.", {("id_number", "QQ 03 05 27 C")}),
    ("Engine No. 982-11-2803 of the Mormophon works was sold. Order No. 485-20-387 for oats. ISSN 0688-1919.", set()),
    ("Fire broke out at 64 Church Place on Thursday. The tenants of Copper Street agreed.", {("street", "64 Church Place")}),
    ("Das Feuer brach im Hause Mühlgasse 6 aus. Die Preise für Hafer blieben unverändert.", {("street", "Mühlgasse 6")}),
    ("The prize for herring went to Gerina Jassenfeld of Tarnbury. TRY Rushoway & Co. for oats.", {("name", "Gerina Jassenfeld")}),
    ("Messrs. Dunnquist & Sons have sold oats. Present were D. Pellman, J. A. Ostenler and Miss Rushwick.", {("name", "D. Pellman"), ("name", "J. A. Ostenler"), ("name", "Rushwick")}),
    ("MARRIED at Hestmouth, Tamric Trev-\neaux to Ardard Pellomer. The Sedgler Hall concert was given.", {("name", "Tamric Trev-\neaux"), ("name", "Ardard Pellomer")}),
]


@pytest.mark.parametrize("text,want", CASES)
def test_spans(tagger, text, want):
    assert found(tagger, text) == want


ORDINARY = [
    ("Her SSN is 123-45-6789 and she lives in Ohio.", {("id_number", "123-45-6789")}),
    ("We met Priya Raghunathan at the station.", {("name", "Priya Raghunathan")}),
    ("The letter was signed by Olumide Adeyemi on Friday.", {("name", "Olumide Adeyemi")}),
    ("He lives at 12 Elm Dr. in Denver now.", {("street", "12 Elm Dr.")}),
    ("You can mail info@posteo.de for the list.", {("email", "info@posteo.de")}),
    ("Professor Ostenler and Captain Baker spoke first.", {("name", "Ostenler"), ("name", "Baker")}),
    ("Call 212-555-0147 or write to jane.doe@firm.co.uk. The office is closed.", {("phone", "212-555-0147"), ("email", "jane.doe@firm.co.uk")}),
    ("Order No. 4711-22 was shipped in 1987 for 12.50 and see page 45.", set()),
]


@pytest.mark.parametrize("text,want", ORDINARY)
def test_sentences_unlike_the_pages(tagger, text, want):
    assert found(tagger, text) == want


@pytest.mark.parametrize("text,piece,kind,want", [
    ("It was won by Captain Rushwick on Monday.", "Rushwi", 5, "Rushwick"),
    ("Mail to info@firm.co.uk, or write.", "info@firm.co.uk,", 1, "info@firm.co.uk"),
    ("Ask (A. Branwick). More", "(A. Branwick).", 5, "A. Branwick"),
    ("BRANWICK, A. was there", "BRANWICK, A", 5, "BRANWICK, A."),
    ("Lot at 9 Mill St. near", "9 Mill St.", 4, "9 Mill St."),
    ("He moved to 9 Mill Lane.", "9 Mill Lane", 4, "9 Mill Lane"),
    ("Ring (01632) 960913 now", "01632) 960913", 2, "(01632) 960913"),
    ("Ask Branwick here", "k Bran", 5, "Branwick"),
    ("Nothing ... here", "...", 5, None),
])
def test_spans_keep_to_whole_words_without_punctuation(text, piece, kind, want):
    a = text.index(piece)
    got = personal.settle(text, a, a + len(piece), kind)
    assert (got and text[slice(*got)]) == want


def test_windows_are_reconciled_in_overlaps():
    """What only the first of two windows is sure of holds up to 8 signs before its cut, in the other window's half too."""
    first, cut = pages.WINDOW - pages.OVERLAP, pages.WINDOW - 8

    class Sure(Tagger):
        def scores(self, x):
            e = np.zeros((x.shape[0], self.kinds + 1, x.shape[1]), np.float32)
            e[:, 0] = 1
            whole = (x != 0).all(0)
            e[first:cut, 5, whole], e[first:cut, 0, whole] = 100, 0
            return e

    tagger = Sure(pages.SIGNS, len(personal.KINDS))
    tagger.p["cross"][:] = 0
    long = pages.WINDOW + 100
    tags = pages.tag(tagger, pages.points("x" * long), np.array([[0, long]]))
    assert pages.runs(tags).tolist() == [[first, cut, 5]]


def test_cutting_where_the_outside_is_sure_changes_no_path(tagger, data):
    """Tags of whole pages are those of one Viterbi over each page."""
    texts = [t for t in pq.read_table(f"{data}/documents.parquet", columns=["text"]).to_pydict()["text"] if t][:20] + [c[0] for c in CASES]
    views = [pages.clean(t)[0] for t in texts]
    lengths = np.array([len(v) for v in views])
    starts = np.cumsum(lengths + 1) - lengths - 1
    spans, codes = np.stack([starts, starts + lengths], 1), pages.points("\0".join(views))
    rng = np.random.default_rng(0)
    for blur in (0, 1):  # as they are, and with scores so near each other that nothing is sure for long
        made = Tagger.load(str(personal.WEIGHTS))
        made.p["out"] *= 1 - 0.9 * blur
        made.p["cross"] += (blur * rng.normal(0, 0.5, made.p["cross"].shape)).astype(np.float32)
        tags, e = pages.tag(made, codes, spans), pages.scores(made, codes, pages.windows(spans))
        for a, b in spans.tolist():
            if b > a:
                e[1:, [a, b - 1]] = -1e4  # a text's ends are outside
                assert (tags[a:b] == made.viterbi(np.ascontiguousarray(e[:, a:b].T[:, :, None]), np.zeros((b - a, 1), bool))[:, 0]).all()


def test_empty_blank_and_long(tagger):
    assert personal.spans(tagger, ["", " \n", "x"]) == [[], [], []]
    filler = "The river stood at twenty feet and the council was told of it before noon. "
    text = filler * 3000 + "Write to betwyn.ketbrook@larkpost.test. " + filler * 3000 + "Call 020 7946 0193 or write."
    assert found(tagger, text) == {("email", "betwyn.ketbrook@larkpost.test"), ("phone", "020 7946 0193")}


def test_redaction_keeps_the_rest(spark):
    rows = [(1, "Write to a.branwick@silnet.test. Call 555-0193 or write.", "x"), (2, None, "x"), (None, "Telephone 020 7946 0193. Apples.", "x"), (3, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = {r.doc_id: r.text for r in personal.redact_personal(df).collect()}
    assert got == {1: "Write to [EMAIL]. Call [PHONE] or write.", 2: None, None: "Telephone [PHONE]. Apples.", 3: ""}
    spans = {tuple(r) for r in personal.find_personal(df).collect()}
    assert spans == {(1, "email", 9, 31), (1, "phone", 38, 46)}
    assert personal.find_personal(df.limit(0)).count() == 0


def test_what_a_page_is_tagged_with_doesn_t_matter(tagger, data):
    texts = [t for t in pq.read_table(f"{data}/documents.parquet", columns=["text"]).to_pydict()["text"] if t][:60] + [c[0] for c in CASES]
    assert personal.spans(tagger, texts) == [s for t in texts for s in personal.spans(tagger, [t])]


def test_held_out_accuracy(tagger, data):
    table = pq.read_table(f"{data}/documents.parquet", columns=["text"]).to_pydict()["text"]
    parts = pq.read_table(f"{data}/known_name.parquet").to_pydict()
    lexicon = shapes.Names(list(zip(parts["name_part"], parts["part_kind"], strict=True)))
    scores = train_personal.accuracy(tagger, [t for t in table if t], lexicon)
    assert all(p > 0.85 and r > 0.85 for p, r, n in scores.values() if n >= 20), scores


def test_made_sentences(tagger):
    scores = train_personal.made_accuracy(tagger, 600)
    assert all(p > 0.88 and r > 0.88 for p, r, _ in scores.values()), scores


def test_made_spans_are_where_they_are_said_to_be():
    maker = train_personal.Maker(5)
    for _ in range(200):
        text, spans = maker.sentence()
        assert all(0 <= a < b <= len(text) and text[a:b].strip() == text[a:b] for a, b, _ in spans)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    view = "Ask Ard Bran, 7 Mill Street, or a.b@silnet.test."
    tags = np.zeros(len(view), np.int8)
    for piece, kind in (("Ard Bran", 5), ("7 Mill Street", 4), ("a.b@silnet.test", 1)):
        at = view.index(piece)
        tags[at : at + len(piece)] = kind
    new, kept = maker.refilled(view, tags, pages.runs(tags).tolist())
    assert len(new) == len(kept) and [k for *_, k in pages.runs(kept).tolist()] == [5, 4, 1] and new.startswith("Ask ") and new.endswith(".") and "Ard Bran" not in new


def test_a_small_tagger_learns():
    lexicon = shapes.Names(NAMES)
    texts = [f"Notice {i}. The prize went to Ard{g} Bran{s} of Weir on Monday. Ask for Drew{s}'s apples here." for i, (g, s) in enumerate([(g, s) for g in ("ane", "ella", "ric", "wyn") for s in ("brook", "quist", "stead", "wick")])]
    tagger = train_personal.train(texts * 20, lexicon, hidden=16, epochs=6, batch=64)
    precision, recall, n = train_personal.accuracy(tagger, texts, lexicon)["name"]
    assert n == 16 and precision > 0.9 and recall > 0.9


def test_two_workers_give_the_gradient_of_one():
    rng = np.random.default_rng(1)
    windows = [(rng.integers(1, 9, 7), rng.integers(0, 2, 7)) for _ in range(10)]
    one, two = (Tagger(9, 2, 4) for _ in range(2))
    a, b = one.fit(windows, epochs=2, batch=5), two.fit(windows, epochs=2, batch=5, workers=2)
    assert np.allclose(a, b, rtol=1e-3) and all(np.allclose(one.p[k], two.p[k], atol=1e-3) for k in one.p)


def test_gradient_and_viterbi():
    import itertools

    rng = np.random.default_rng(0)
    small = Tagger(9, 2, 4)
    small.p = {k: v.astype(np.float64) for k, v in small.p.items()}
    x, y = rng.integers(1, 9, (6, 3)), np.array([[0, 1, 0], [1, 1, 0], [1, 0, 0], [0, 0, 2], [2, 0, 2], [2, 2, 0]])
    x[4:, 1], y[4:, 1] = 0, 0  # a window that ends early
    _, grad = small.loss(x, y)
    for k in small.p:
        for i in list(np.ndindex(*small.p[k].shape))[3::7]:
            if k == "near" and i[1] == 0:
                continue
            held = small.p[k][i]
            small.p[k][i] = held + 1e-5
            up, _ = small.loss(x, y)
            small.p[k][i] = held - 1e-5
            down, _ = small.loss(x, y)
            small.p[k][i] = held
            assert abs((up - down) / 2e-5 - grad[k][i]) < 1e-6
    small = Tagger(9, 2, 4)
    x = rng.integers(1, 9, (6, 2))
    e, move = small.scores(x), small.moves()
    for b in range(2):
        best = max(itertools.product(range(3), repeat=6), key=lambda s, b=b: sum(e[i, s[i], b] for i in range(6)) + sum(move[s[i], s[i + 1]] for i in range(5)))
        assert tuple(small.decode(x)[:, b]) == best


def test_windows_cover_texts():
    w, o = pages.WINDOW, pages.OVERLAP
    spans = np.array([[3, 50], [60, 60], [100, 100 + w], [2 * w, 3 * w + 1], [4 * w, 9 * w]])
    cuts = pages.windows(spans)
    for a, b in spans.tolist():
        mine = [c for c in cuts.tolist() if a <= c[0] < b]
        assert {i for x, y, _ in mine for i in range(x, y)} == set(range(a, b)) and [f for *_, f in mine] == [1, *[0] * (len(mine) - 1)][: len(mine)]
        assert all(y - x <= w for x, y, _ in mine) and all(q[0] == p[1] - o for p, q in zip(mine, mine[1:]))
    assert len(pages.windows(np.zeros((0, 2), int))) == 0


def test_cleaning_keeps_offsets():
    text = "Thorn-\r\nwick\xad\nby, nea\xb7r 555-\n0131 and Fe-\nTam"
    view, offsets = pages.clean(text)
    assert view == "Thornwickby, near 555-0131 and Fe- Tam" and all(text[o] == c or text[o] == "\n" for o, c in zip(offsets, view))


def test_scores_reuse_their_memory():
    import tracemalloc

    tagger = Tagger(pages.SIGNS, len(personal.KINDS))
    x = np.random.default_rng(1).integers(1, pages.SIGNS, (320, 64)).astype(np.uint8)
    tagger.scores(x)
    tracemalloc.start()
    tagger.scores(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.size * 2 * tagger.hidden * 4  # less than the states alone


def test_scores_do_not_depend_on_calls_before():
    rng, used = np.random.default_rng(2), Tagger(pages.SIGNS, len(personal.KINDS))
    near = used.p["near"]
    for steps, width in ((90, 7), (1, 1), (33, 3), (32, 9), (64, 2), (2, 5), (31, 7)):
        x = rng.integers(1, pages.SIGNS, (steps, width)).astype(np.uint8)
        x[steps - steps // 3 :, -1] = 0
        e = near[1][x]
        e[1:] += near[0][x[:-1]]
        e[:-1] += near[2][x[1:]]
        assert np.array_equal(used._inputs(x, np.empty((steps, e.shape[2], width), np.float32)), e.transpose(0, 2, 1))
        assert np.array_equal(used.scores(x), Tagger(pages.SIGNS, len(personal.KINDS)).scores(x))
