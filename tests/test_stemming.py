"""Snowball stemmers on words of their published vocabularies, searches and counts over the tables."""

import math
import os
import random
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from corvane.functions import text as tx
from corvane.functions.stemming import SNOWBALL
from corvane.operators import fts
from corvane.sources import text_index
from corvane.sources.store import Store

SF = "/root/testdata/sf0.001"

#: Words and their stems, in turn, as published with the algorithms.
PUBLISHED = {
    "german": "aufeinander aufeinand aufeinanderfolge aufeinanderfolg aufeinanderfolgende aufeinanderfolg aufeinanderfolgenden aufeinanderfolg aufeinanderfolgt aufeinanderfolgt aufeinanderfolgten aufeinanderfolgt aufeinanderschlügen aufeinanderschlug kategorie kategori kategorien kategori kategorisch kategor kategorischen kategor kater kat katze katz katzen katz kätzchen katzch",
    "french": "continu continu continua continu continuait continu continuant continu continuation continu continué continu continuel continuel continuelle continuel continuellement continuel continuelles continuel continuer continu continuera continu continueront continu continuez continu continuité continu continuons continuon contorsions contors contour contour contournait contourn contourne contourn contours contour contracté contract contractions contract contradictoirement contradictoir contradictoires contradictoir contraindre contraindr contraint contraint contrainte contraint contraire contrair contraria contrari main main mains main maintenaient mainten maintenant mainten maintenir mainten maintenue maintenu maintien maintien maintint maintint maire mair mairie mair mais mais maison maison maître maîtr maîtresse maîtress majesté majest majestueuse majestu majestueusement majestu majestueux majestu majeur majeur majordome majordom majorité major",
    "spanish": "cheque chequ cheques chequ chequeo cheque chicago chicag chica chic chicharrones chicharron chicles chicl chihuahua chihuahu chilena chilen chirac chirac torá tor tórax torax toreado tor toreándolo tor torear tor toreara tor torearlo tor toreó tore torero torer tormenta torment tormentas torment tornado torn tornen torn torneo torne tornillo tornill toronto toront toros tor torpedearon torped torpeza torpez torre torr torrencial torrencial torrenciales torrencial torrente torrent",
    "italian": "abbandonata abbandon abbandonerà abbandon abbandoneranno abbandon abbassamento abbass abbassandola abbass abbassar abbass abbassava abbass abbassò abbass abbastanza abbast abbatté abbatt abbattendo abbatt abbattersi abbatt abbattesse abbattess pronto pront pronuncerà pronunc pronunciamento pronunc pronunciarsi pronunc pronunziarle pronunz pronunziasse pronunz propaga propag propaganda propagand propagazione propag propaghino propaghin propende prop propensi propens propensione propension propio prop propizio propiz propone propon",
    "portuguese": "boa boa boas boas boataria boat boate boat boatos boat boba bob bobagem bobag bobagens bobagens bobalhões bobalhõ bobear bob bobeira bobeir bobinho bobinh boca boc bocadas boc bocadinho bocadinh bocaiúva bocaiúv boçal boçal bode bod bodoque bodoqu boemia boem boêmio boêmi bogotá bogot boi boi bóia bói boiando boi quiosque quiosqu quiosques quiosqu quis quis quiseram quis quisesse quis quitandinha quitandinh quito quit quociente quocient",
    "swedish": "jakt jakt jaktbössa jaktböss jakten jakt jakthund jakthund jaktkarlarne jaktkarl jaktkarlens jaktkarl jaktlöjtnantens jaktlöjtnant jalusi jalusi jalusierna jalusi jamaika jamaik jamat jam jamrande jamr jamt jamt jande jand japanska japansk jaquette jaquet jaquettekappa jaquettekapp klo klo kloaken kloak klocka klock klockan klockan klockorna klock klokare klok klokast klok klokaste klok klokt klokt",
    "danish": "indtage indtag indtagelse indtag indtager indtag indtages indtag indtaget indtag indtil indtil indtog indtog indtræde indtræd indtræffe indtræf indtrængende indtræng indtægt indtæg indtægter indtæg indvandrede indvandred indvandret indvandr indvendig indvend indvendigt indvend indvending indvending indvendingerne indvending indvie indvi indvielse indvi indvolde indvold indvoldene indvold indvortes indvort",
    "norwegian": "havnedistrikt havnedistrikt havnedistriktene havnedistrikt havnedistriktets havnedistrikt havnedrift havnedrift havnedriften havnedrift havneeier havneei havneeiere havneeier havneenheter havneen havneforvaltningene havneforvaltning opning opning opninga opning",
}


@pytest.mark.parametrize("language", PUBLISHED)
def test_published_words(language):
    w = PUBLISHED[language].split()
    assert {a: SNOWBALL[language](a) for a in w[::2]} == dict(zip(w[::2], w[1::2], strict=True))


@pytest.mark.parametrize("language", SNOWBALL)
def test_any_word(language):
    """Short words, digits, foreign letters: a stem is never longer than the word, but for ß, and never empty for a word of three letters."""
    rng = random.Random(3)
    for _ in range(20_000):
        w = "".join(rng.choice("aeiouyéèqunstrlmgcyèßiäöå1ж") for _ in range(rng.randint(0, 8)))
        s = SNOWBALL[language](w)
        assert len(s) <= len(w) + w.count("ß") + 2 and s == s.lower()


def words(text, language):
    """Runs of letters and digits, by a plain loop."""
    runs = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text or "").split()
    low = [r.lower() for r in runs]
    if language in SNOWBALL:
        return low
    return ["".join(unicodedata.normalize("NFD", c)[0] if 0xC0 <= ord(c) < 0x250 and unicodedata.normalize("NFD", c)[0].isascii() else c for c in w) for w in low]


@pytest.fixture(scope="module")
def rows(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").collect()


@pytest.mark.parametrize(("name", "language", "query"), [("fts_german", "german", "einen nichtes"), ("fts_french", "french", "mentonne dans"), ("fts_spanish", "spanish", "paras conos")])
def test_search(spark, rows, name, language, query):
    """BM25 over stems, document by document; the words of the query stand in no text as they are."""
    cut = SNOWBALL[language]
    docs = {r["doc_id"]: [cut(w) for w in words(r["text"], language)] for r in rows}
    want = [cut(w) for w in query.split()]
    avg = sum(map(len, docs.values())) / len(docs)
    df = {w: sum(w in set(d) for d in docs.values()) for w in want}
    score = {}
    for i, d in docs.items():
        n = Counter(d)
        if all(n[w] for w in want):
            score[i] = sum(max(math.log((len(docs) - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) * n[w] * 2.2 / (n[w] + 1.2 * (0.25 + 0.75 * len(d) / avg)) for w in want)
    got = {r["id"]: r["score"] for r in E.queries()[name](spark, SF).collect()}
    assert score and got.keys() == score.keys() and all(abs(got[i] - s) < 1e-9 for i, s in score.items())


def test_stem_counts(spark, rows):
    names = {"de": "german", "fr": "french", "es": "spanish"}
    n, docs, forms = Counter(), defaultdict(set), defaultdict(set)
    for r in rows:
        language = names.get(r["lang"], "english" if r["lang"] == "en" else "simple")
        cut = SNOWBALL.get(language) or (tx.stem if language == "english" else str)
        for w in words(r["text"], language):
            k = (r["lang"], cut(w))
            n[k] += 1
            docs[k].add(r["doc_id"])
            forms[k].add(w)
    got = {(r["lang"], r["stem"]): (r["df"], r["cf"], r["forms"]) for r in E.queries()["stem_counts"](spark, SF).collect()}
    assert got == {k: (len(docs[k]), c, len(forms[k])) for k, c in n.items()}


def test_index_and_texts_agree(spark, tmp_path):
    """In French accents count; an index, the texts and the marks use the same stems."""
    d = spark.createDataFrame([("a", "Les maisons continuaient"), ("b", "la maison, continuellement"), ("c", "pêche"), ("d", "peche"), ("e", None), ("f", "")], "id string, text_content string")
    st = Store(spark, str(tmp_path))
    text_index.build(st, d, "french")
    index = text_index.open_index(st, "french")
    for q, ids in (("maisons", "ab"), ("continuer", "a"), ("pêches", "c"), ("peches", "d"), ("absente", "")):
        tree = fts.parse(q, "match", "french")
        a, b = (sorted((r["id"], round(r["score"], 9)) for r in h.collect()) for h in (fts.search(d, q, "match", "french"), index.search(tree)))
        assert a == b and "".join(i for i, _ in a) == ids
    got = d.filter("id = 'b'").select(fts.highlight(F.col("text_content"), fts.parse("maisons", "match", "french"), "french")).first()[0]
    assert got == "la <mark>maison</mark>, continuellement"
    assert fts.parse("maisons", "match", "dutch") == fts.Leaf(("maisons",))  # no stemmer


def test_terms_by_row(spark):
    d = spark.createDataFrame([("Häuser", "german"), ("Häuser", None), ("houses", "english"), (None, "french"), ("casas", "SPANISH"), ("huizen", "dutch")], "t string, l string")
    got = [[tuple(x) for x in r[0]] for r in d.select(tx.terms_by_row(F.col("t"), F.col("l"))).collect()]
    assert got == [[("häuser", "haus")], [("hauser", "hauser")], [("houses", "hous")], [], [("casas", "cas")], [("huizen", "huizen")]]
