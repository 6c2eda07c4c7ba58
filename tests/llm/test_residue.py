import numpy as np
import pytest

from quarry.llm import residue, residue_rules as rules

RESIDUE = [
    "'''Elton''' is a village in {{{district|}}} with 30 inhabitants.", "| name = @@year@@", "| %POPULATION% || 3", "Die Mühle von [insert name here] wurde erneuert.", "This page covers {{ river }} and more.", "Le pont de ${genus} date de 1500.", "<%= river %> is a river.", "[NAME TBD] N, 4 E.",
    "Please enable JavaScript in your browser to read this page.", "Pl3ase enabl3 JavaScript in y0ur browser.", "SCRIPTS ARE BLOCKED.", "<div class=\"notice\">Cette page nécessite des scripts ; activez-les.</div>", "Loading… if nothing happens, your browser\nmay be blocking scripts.", "<noscript>Your browser does not support scripts</noscript>", "Enable&nbsp;JS and disable any ad blocker to continue.",
    "Error 404 – the page “Elton” could not be found on this server.", "502 Bad Gateway\n-----\nupstream closed the connection", "Traceback (most recent call last):\n  File \"bot.py\"", "'''Access denied.'''", "Warning: Undefined index: rev in /srv/x.inc on line 3", '{"error": {"code": "nosuchrevid"}}', "<error code=\"3\" info=\"missing title\" />", "Fatal error: call to a member function getText() on null", "HTTP 429: the request for “Elton” was not completed.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "text text text text", "Coming soon!", "Section text to be added.", "Texte à venir.", "Your text goes here.", "Replace this paragraph before saving.", "[placeholder paragraph – write two sentences]", "TODO: describe the history of this place.", "Lead sentence. Second sentence. Third sentence.", "Sample heading. Sample text.", "Beispieltext Beispieltext Beispieltext",
]
#: Residue and genuine sentences of other kinds of pages than those of the test tables. Not held out: the rules were tuned on them, but
#: for the last nine residues and six of the genuine ones ({0}, <ENTER>, __FILE__, ferries, custodes, dolor), which were added afterwards.
UNSEEN_RESIDUE = [
    "Page not found", "This page isn't working right now.", "Cookies must be enabled to view this website.", "[Company Name] was founded in [Year].", "Hello {name}, welcome", "{% block content %}", "You need to enable JavaScript to run this app.",
    "Sorry, the page you requested could not be found.", "404 Not Found", "The server encountered an internal error and was unable to complete your request.", "Please turn on JavaScript and reload the page.", "Dear {{ user.first_name }}, thank you.", "Your connection was interrupted. Please try again later.",
    "This site requires cookies.", "Text coming soon.", "Description to follow.", "Insert your text here.", "We're sorry, something went wrong.", "This content is currently unavailable.", "Diese Seite ist zurzeit nicht erreichbar.", "Bitte aktivieren Sie Cookies in Ihrem Browser.", "Cette page n'existe pas.", "La página no está disponible.", "Hola ${nombre}, bienvenido.",
    "%FIRST_NAME% lives in %CITY%.", "An unexpected error has occurred.", "Session timed out. Please log in again.", "Details will be added later.", "Access forbidden", "This section is under construction.", "Your browser is out of date.", "Uncaught TypeError: Cannot read properties of undefined (reading 'length')", "Exception in thread \"main\" java.lang.NullPointerException",
    "The requested resource is not available.", "Please log in to continue.", "Content to be added", "Service temporarily unavailable", "JavaScript must be enabled.", "Signed [Your Name]", "This video is no longer available.", "Please wait while the page is loading and try again.", "Dieser Inhalt ist nicht verfügbar.",
]
UNSEEN_CONTENT = [
    "Division by zero is undefined in the real numbers.", "Of the three candidates None was elected.", "HTTP 404 is the status code for a missing page.", "Internal server error was not the cause of the outage, the report said.", "The page was not found until 1950.", "The mill was not available to visitors.", "Work on the bridge was not completed until 1903.",
    "The section of the canal was under construction in 1890.", "He was denied access to the archive.", "The text was written in Latin.", "The second section was added in 1901.", "The manuscript no longer exists.", "The road is no longer available to lorries.", "The treaty has expired.", "The first paragraph describes the town.", "The database contains 500 entries.", "She did not answer the letter.",
    "The king would be back soon.", "The church is closed and will be restored.", "Null is a village in Belgium.", "The tower was not accessible from the street.", "The request was refused by the council.", "An example sentence in the grammar shows the dative.", "The site is not open to the public.", "The server of the tavern was not found guilty.", "Your text is a book by Anna Maier.", "Details follow in the next chapter.",
    "The set {a} is open in the plane.", "The set {0} is closed under addition.", "The article [[Year]] lists events.", "The script of the play requires three actors.", "The browser wars ended in 2001.", "The article was not written by the editor.", "Press <ENTER> to accept.", "The macro __FILE__ holds the name of the source.", "Ferries wait at the pier and try the channel again at high tide.", "Quis custodiet ipsos custodes? Sed quis scit.", "El dolor de la madre no ha cesado.",
]
CONTENT = [
    "To pass a value, write <nowiki>{{{name}}}</nowiki> in the template.", "The code <code>{{{district|}}}</code> is explained.", "<syntaxhighlight lang=\"sh\">\nexport A=${BASE}/wiki\nprintf '%s pages' \"$COUNT\"\n</syntaxhighlight>", "In the formula <math>f_{0} = x</math> the first term counts.",
    "In network talk a 404 answer means that a page was not found; someone argued that servers should explain why.", "The word ''undefined'' on their plaque is a joke.", "The timetable marks a missing boat by XXXX, as Joru noted: “XXXX means no sailing”.", "Printers used made-up Latin, later known as “lorem ipsum”, to judge a page.", "''Coming soon'' and ''Details to follow'' are two songs.",
    "Access to the tower was denied to visitors until 1953, when its stair was repaired.", "JavaScript is a language for web pages.", "Some readers switch scripts off, and its editors offer them a plain edition.", "The database of the herbarium had an error in 2013.", "The exhibit “Error 503” opened in 2006; visitors wait at a door that never answers.",
    "None of the mills survived.", "{{stub}}", "{{Infobox place\n| name = Elton\n| founder = \n}}", "#REDIRECT [[Elton#History]]", "lol lol lol lol lol", "aaaaaaaaaaaaaaaaaaa", "File:Old_mill-%C3%A9.jpg|The mill", "__NOTOC__", "<REF>ELTON, 1730.</REF>", "The page has an infobox with some fields left blank.", "A gateway of granite is the only bad part; the service there was unavailable on Sundays.",
]


def kinds(text):
    return {k for p in rules.passages(text) if (k := rules.trusted(p, rules.fold(p)))}


@pytest.mark.parametrize("text", RESIDUE)
def test_residue(text):
    assert kinds(text) and kinds("A mill stands here. " + "It is old.\n\n" + text + "\n\nMore text follows it.")


@pytest.mark.parametrize("text", CONTENT)
def test_content(text):
    assert not kinds(text)


def test_recall_and_precision_on_unseen_sentences():
    found = [t for t in UNSEEN_RESIDUE if kinds(t)]
    wrong = [t for t in UNSEEN_CONTENT if kinds(t)]
    assert len(found) >= 0.9 * len(UNSEEN_RESIDUE), set(UNSEEN_RESIDUE) - set(found)
    assert len(wrong) <= 0.05 * (len(found) + len(wrong)), wrong


def found_in(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "id long, body string")
    return {r.id: (r.kinds, r.by_rule) for r in residue.find_residue(df, key="id", text="body").collect()}


def test_ambiguous_words_are_decided_by_near_duplicates(spark):
    marks = ["undefined", "None", "NaN", "XXXX", "__RIVER__", "<YEAR>", "#NAME#", "{0}", "null"]
    texts = {n: f"The ferry to {m} runs 3 times a day." for n, m in enumerate(marks)}
    texts |= {n + 20: t for n, t in enumerate(UNSEEN_CONTENT)} | {n + 70: t for n, t in enumerate(CONTENT)}
    assert found_in(spark, texts) == {}
    suspects = {n: (["value"], False) for n in range(len(marks))}
    assert found_in(spark, texts | {100: "The ferry to Elton runs 5 times a day."}) == suspects
    assert found_in(spark, texts | {100: "The ferry to {{{place}}} runs 5 times a day."}) == suspects | {100: (["placeholder"], True)}
    table = {
        1: "{|\n| XXXX || {0}\n|}", 2: "{|\n| Elton || 7\n|}", 3: "It says ''undefined'' there, which is undefined.", 6: "It says Elton there, which is Marton.",
        4: "Source.<ref>NaN, ''Survey of Elton'', NaN.</ref>", 5: "Another.<ref>{{{who}}}, ''Survey of Marton'', 1950.</ref>",
    }
    assert found_in(spark, table) == {1: (["value"], False), 4: (["value"], False), 5: (["placeholder"], True)}


def test_filler_words_are_learned_from_the_public_ones(spark):
    rng = np.random.default_rng(3)
    made_up, public = ["quamlo", "tirrat", "belsin", "ordam", "fenquis", "lomir", "sattem", "ulvor"], ["lorem", "ipsum", "tempus", "velit"]
    texts = {n: " ".join(rng.choice(made_up + public, 12)).capitalize() + "." for n in range(30)}
    texts |= {50: "Quamlo tirrat belsin ordam fenquis lomir.", 51: "The word quamlo is said to be a name of the river.", 52: "Sattem."}
    texts |= {n + 60: f"The mill of Elton has {n} wheels and a long race." for n in range(8)}
    found = found_in(spark, texts)
    assert set(found) == set(range(30)) | {50} and found[50] == (["filler"], False)


def test_simhash_distances():
    base = "the quick brown fox jumps over the lazy dog near the old river bank at noon while seven herons watch from the pier"
    same, near, far, short, empty = residue.simhashes([base, base + " again", "completely other words that say nothing alike at all about any animal or water", "two words", ""])
    distance = lambda a, b: bin((int(a) ^ int(b)) & (1 << 64) - 1).count("1")
    assert residue.simhashes([base])[0] == same and distance(same, near) < distance(same, far)
    assert residue.simhashes([]).tolist() == [] and short != empty


def test_tables_find_every_pair_within_three_bits(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63 - 1, 200)
    flipped = [int(np.int64(np.uint64(x) ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, residue.HAMMING, replace=False))))) for x in base.astype(np.uint64)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(int(a), b) for a, b in zip(base, flipped, strict=True)], "a long, b long")
    shared = F.size(F.array_intersect(residue.table_entries(F.col("a")), residue.table_entries(F.col("b"))))
    assert df.where(shared == 0).count() == 0


def test_documents_and_propagation(spark):
    notice = "please enable javascript in your browser and reload the page to view the content of this article because the site does not work without scripts and may not be displayed in a browser which has its scripts turned off again"
    likeness = notice + " by its kind owner on that day in May"
    assert kinds(notice) and not kinds(likeness)
    plain = "the mill was built by weavers."
    data = [(1, notice), (2, likeness), (3, plain), (4, None), (5, ""), (6, " \n\n "), (7, "Coming soon!"), (7, plain), (None, "Coming soon!"), (8, (plain + "\n\n") * 20_000 + "| name = {{{x}}}"), (9, likeness.replace("page", "''page''"))]
    df = spark.createDataFrame([(*r, "k", 1) for r in data], "id long, body string, key string, doc int")
    found = {r.id: r.kinds for r in residue.find_residue(df, key="id", text="body").collect()}
    assert found == {1: ["script notice"], 2: ["script notice"], 7: ["filler"], 8: ["placeholder"]}
    assert residue.find_residue(df.limit(0), key="id", text="body").collect() == []


def test_label_reaches_near_duplicates_only(spark):
    words = [f"word{i}" for i in range(120)]
    seed = "access denied. " + " ".join(words)
    texts = {1: " ".join(words), 2: " ".join(words[:-1] + ["changed"]), 3: " ".join(words[:60])}
    passages = spark.createDataFrame([(k, t, None, residue.OPEN) for k, t in texts.items()] + [(9, " ".join(words), "error", residue.OPEN)], "key long, folded string, kind string, role int")
    hashed = residue.with_simhash(passages)
    seeds = hashed.where("kind IS NOT NULL").select("key", "folded", "kind", "sim")
    for small in (True, False):
        got = {r.key for r in residue.neighbours(seeds, hashed, small).collect()}
        assert 1 in got and 3 not in got
    assert seed


def test_every_pair_above_the_similarity_is_found(spark):
    rng = np.random.default_rng(7)
    texts, kinds = [], []
    for seed in range(60):
        words = [f"w{rng.integers(400)}" for _ in range(int(rng.integers(3, 90)))]
        texts.append(" ".join(words))
        kinds.append("error")
        for _ in range(8):
            changed = list(words)
            for at in rng.choice(len(words), min(len(words), int(rng.integers(1, 4))), replace=False):
                changed[at] = "other"
            cut = int(rng.integers(0, 1 + len(words) // 8))
            texts.append(" ".join(changed if rng.random() < 0.4 else words[cut:] + ["more"] * int(rng.integers(0, 2))))
            kinds.append(None)
    sets = [{tuple(w[i : i + residue.WORDS]) for i in range(max(1, len(w) - residue.WORDS + 1))} for w in map(str.split, texts)]
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    want = {n for n, k in enumerate(kinds) if not k and any(k2 and alike(sets[n], sets[m]) for m, k2 in enumerate(kinds))}
    hashes = residue.simhashes(texts)
    far = {n for n in want if all(bin((int(hashes[n]) ^ int(hashes[m])) & (1 << 64) - 1).count("1") > residue.HAMMING for m, k in enumerate(kinds) if k and alike(sets[n], sets[m]))}
    assert len(want) > 150 and len(far) > 50
    hashed = residue.with_simhash(spark.createDataFrame([(n, t, k, residue.OPEN) for n, (t, k) in enumerate(zip(texts, kinds, strict=True))], "key long, folded string, kind string, role int"))
    seeds = hashed.where("kind IS NOT NULL").select("key", "folded", "kind", "sim")
    for small in (True, False):
        assert {r.key for r in residue.neighbours(seeds, hashed, small).collect()} == want


def test_variants_of_a_notice_are_reached_by_masked_blocks(spark):
    notice = "Forbidden: the server at {} has sent the page {} to the user but the content of the site is only for a reader with an account of the wiki and the pages of the app."
    stub = "The mill at {} stands by the river and has two wheels that turn from May to June every year since {} at least."
    texts = {
        1: notice.format("Marton", 319), 2: notice.format("Upper Elton", "7,200").replace("Forbidden", "Unlucky"), 3: notice.format("Elton", 7).replace("Forbidden", "Unlucky").replace("page", "''page''"),
        4: stub.format("Marton", 1730) + " Coming soon.", 5: stub.format("Elton", 1811), 6: "Before it.\n\n" + notice.format("Orreach", 5).replace("Forbidden", "Unlucky") + "\n\nAfter it.",
    }
    assert not kinds(texts[2]) and kinds(texts[4]) == {"filler"}
    found = {r.id: r.kinds for r in residue.find_residue(spark.createDataFrame(list(texts.items()), "id long, body string"), key="id", text="body").collect()}
    assert found == {1: ["error"], 2: ["error"], 4: ["filler"], 6: ["error"]}


def test_null_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "Coming soon!", "c"), (None, "Coming soon!", "d"), (3, "Coming soon!", "e")], "key long, folded string, kind string")
    found = residue.find_residue(df, key="key", text="folded").collect()
    assert [(r.key, r.kinds) for r in found] == [(3, ["filler"])]


def test_stub_queries_are_listed():
    from quarry.llm import queries

    assert list(queries.QUERIES)[0] == "p1_daily" and {"p4_found", "p8_ids", "p9_found", "p10_found"} <= set(queries.QUERIES)
