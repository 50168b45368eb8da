"""Stems against the published sample vocabularies, and searches that use them."""

import pytest
from pyspark.sql import functions as F

from findling.functions import stems
from findling.operators import lexical

ENGLISH = """consign consign consigned consign consigning consign consignment consign consist consist
consisted consist consistency consist consistent consist consistently consist consisting consist consists consist
consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol
consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol
consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu
conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir
constable constabl constables constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead
kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt
knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit
knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker
knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
generate generat generously generous communism communism dying die news news sky sky skies sky hopping hop
hoping hope relational relat happy happi by by say say falling fall gas gas gaps gap kiwis kiwi this this"""
GERMAN = """aufeinander aufeinand aufeinanderfolge aufeinanderfolg aufeinanderfolgende aufeinanderfolg
auferlegt auferlegt auferlegten auferlegt auferstanden auferstand auferstehen aufersteh aufersteht aufersteht
auferstehung aufersteh auffallend auffall auffallenden auffall auffällig auffall kategorie kategori
kategorien kategori kategorisch kategor kategorische kategor kategorischen kategor kater kat katers kat katze katz
kätzchen katzch kauen kau kaufen kauf kaufleute kaufleut kaufmann kaufmann häuser haus straße strass
möglichkeiten moglich freundlichkeit freundlich bäume baum"""
LIGHT = {
    "fr": "chevaux cheval maisons maison grande grand grandes grand chat chat données don",
    "es": "casas cas libros libr luces luz ciudades ciudad inglesas ingles rápido rapid sol sol",
}


@pytest.mark.parametrize("lang,sample", [("en", ENGLISH), ("de", GERMAN), *LIGHT.items()])
def test_sample_vocabulary(lang, sample):
    pairs = sample.split()
    wrong = [(w, stems.stem(w, lang), s) for w, s in zip(pairs[::2], pairs[1::2]) if stems.stem(w, lang) != s]
    assert not wrong


def test_other_words_stay(spark):
    rows = [(["running", "because", "x1s"], "en"), (["running"], "xx"), (["running"], None), ([], "de"), (None, "en")]
    df = spark.createDataFrame(rows, "words array<string>, lang string")
    got = [r[0] for r in df.select(stems.stemmed(F.col("words"), F.col("lang"))).collect()]
    assert got == [["run", "because", "x1s"], ["running"], ["running"], [], None]


CHUNK = "tenant_id string, doc_id bigint, chunk_id string, lang string, text string"


def test_questions_and_postings_meet_by_stem(spark):
    texts = ["The knights were knocking", "a knight knocks twice", "nothing here", "knightly manners, knocked out"]
    chunks = spark.createDataFrame([("t", i, f"{i}:0", "en", x) for i, x in enumerate(texts)], CHUNK)
    asked = spark.createDataFrame(
        [(1, "t", "en", "knight knock"), (2, "t", "en", '"knights knocked"'), (3, "t", "en", "manner -knocking")],
        "query_id bigint, tenant_id string, lang string, text string")
    parsed = lexical.parse_websearch(asked, stem=True)
    postings = lexical.build_postings(chunks, stem=True)
    found = {(r.query_id, r.doc_id) for r in lexical.lexical_match(parsed, postings).collect()}
    assert found == {(1, 0), (1, 1), (1, 3), (2, 1)}
    plain = lexical.lexical_match(lexical.parse_websearch(asked), lexical.build_postings(chunks))
    assert {(r.query_id, r.doc_id) for r in plain.collect()} == set()
    only = lexical.build_postings(chunks, lexical.asked_terms(parsed), stem=True)
    assert {(r.query_id, r.doc_id) for r in lexical.lexical_match(parsed, only).collect()} == found
    terms = lexical.tokenize(chunks, "chunk_id", stem=True)
    assert {r.term for r in terms.filter("chunk_id = '1:0'").collect()} == {"knight", "knock", "twice"}
    stats = lexical.asked_stats(chunks, lexical.asked_terms(parsed), stem=True)
    assert {r.term: r.df for r in stats.collect()} == {"knight": 3, "knock": 3, "manner": 1}
