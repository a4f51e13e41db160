import pytest
from pyspark.sql import functions as F

from strataq.llm.readability import CUTS, fit_cuts, fitted_levels, graded_documents, grades, profile, prose_lines, reading_levels, sentences, syllables

EASY = "You can build a small pool in your yard. Keep the gate shut. Please do not block the way. It is free to ask. The town likes a neat yard. "
HARD = "The administrative determination of the zoning officer shall be restricted to the residential occupancy classifications enumerated herein, irrespective of the classification assigned to the underlying parcel. "


@pytest.mark.parametrize(
    ("word", "n"),
    [("the", 1), ("house", 1), ("houses", 2), ("table", 2), ("tables", 2), ("fence", 1), ("fences", 2), ("allowed", 2), ("permitted", 3), ("area", 3), ("zoning", 2), ("municipal", 4), ("being", 2), ("nation", 2), ("fees", 1), ("quiet", 2), ("a", 1), ("hmm", 1)],
)
def test_syllables(word, n):
    assert syllables(word) == n, word


# Counts as in dictionaries; words of the trade and everyday ones. Some of the rules were written after nine of these were missed.
COUNTED = "animal 3 computer 3 develop 3 condition 3 neighbor 2 neighborhood 3 parcel 2 frontage 2 setback 2 height 1 maximum 3 minimum 3 property 3 vehicle 3 driveways 2 garage 2 fireplace 2 sewer 2 water 2 avenue 3 boulevard 3 hearing 2 appeal 2 council 2 committee 3 commissioner 4 applicant 3 application 4 administrator 5 environmental 5 architecture 4 agricultural 5 historic 3 preservation 4 landscape 2 landscaping 3 perimeter 4 elevation 4 foundation 3 drainage 2 erosion 3 stormwater 3 wetland 2 subdivision 4 nonconforming 4 conditional 4 temporary 4 permanent 3 notwithstanding 4 irrespective 4 pursuant 3 hereinafter 4 thereof 2 whichever 3 herein 2 boundary 3 corner 2 vacant 2 occupied 3 occupancy 4 tenant 2 owner 2 leased 1 fenced 1 painted 2 planted 2 stored 1 parked 1 garbage 2 chickens 2 peaceful 2 carefully 3 wholesale 2 lifeguard 2 bookkeeper 3 librarian 4 radio 3 studio 3 patio 3 ratio 3 violation 4 medium 3 stadium 3 premium 3 curious 3 obvious 3 ordinance 3 adequate 3 graduate 3 manual 3 usual 3 gradual 3 genuine 3 influence 3 affluent 3 reactor 3 reopen 3 giant 2 bias 2 violet 3 society 4 variety 4 anxiety 4 proprietor 4 nowhere 2 anything 3 statewide 2".split()


# Hard words, of which only those in -gue and -que had a rule written for them afterwards.
HARD_WORDS = "kitchen 2 bedroom 2 ceiling 2 window 2 sunlight 2 orchard 2 livestock 2 chimney 2 balcony 3 storage 2 emergency 4 electrical 4 engineer 3 inspector 3 certificate 4 deadline 2 calendar 3 majority 4 testimony 4 decision 3 revision 3 extension 3 provision 3 permission 3 submission 3 designation 4 inhabitant 4 interior 4 exterior 4 superior 4 junior 2 deteriorate 5 appreciate 4 associate 4 negotiate 4 immediate 4 intermediate 5 recreation 4 recreational 5 theatre 3 realtor 3 ideal 3 cereal 3 linear 3 nuclear 3 vehicular 4 archaeology 5 geography 4 geology 4 biology 4 diameter 4 diagram 3 dialogue 3 violence 3 pioneer 3 quotient 2 queue 1 antique 2 unique 2 vague 1 league 1 plaque 1 tongue 1 cottage 2 village 2 mileage 2 acreage 3 sewage 2 drainage 2 lease 1 leases 2 lessees 2 employees 3 guarantee 3 pedestal 3 fertile 2 hostile 2 textile 2 sterile 2 missile 2 agile 2 whole 1 homes 1 sizes 2 places 2 pages 2 bridges 2 hedges 2 trees 1 goes 1 does 1 shoes 1 canoes 2 dyed 1 sued 1 queued 1 argued 2 valued 2 continued 3".split()


def test_syllables_of_hard_words():
    pairs = list(zip(HARD_WORDS[::2], map(int, HARD_WORDS[1::2]), strict=True))
    wrong = {w: (syllables(w), n) for w, n in pairs if syllables(w) != n}
    assert len(wrong) <= 0.12 * len(pairs) and all(abs(a - b) == 1 for a, b in wrong.values()), wrong


def test_syllables_of_counted_words():
    pairs = list(zip(COUNTED[::2], map(int, COUNTED[1::2]), strict=True))
    wrong = {w: (syllables(w), n) for w, n in pairs if syllables(w) != n}
    assert len(wrong) <= 0.06 * len(pairs), wrong


def test_formulas_rise_with_length_and_syllables():
    assert grades(5, 50, 60, 2, 42) < grades(5, 100, 140, 15, 75) < grades(5, 200, 400, 70, 100)


def test_layout_is_no_prose():
    text = "Sec. 9-75. Fences.\n<p>You can ask us &amp; we will help.</p>\nPage 1 of 2\nDistrict|Lot area|Width\nR-1|5,000|40\nSec. 4-1. Yards. ........ 12\n1. Keep the gate shut\n(b) Draw a map of your yard\nfile.tif\n12-334 55-1 44\nThis line is long and hard\nbroken in two."
    assert prose_lines(text) == ["You can ask us & we will help.", "Keep the gate shut", "Draw a map of your yard", "This line is long and hard broken in two."]
    assert len(sentences("See Sec. 4 for the rule. It is on page 3, e.g. Table 2. Then ask us.")) == 3


def test_bands_and_cases():
    assert profile(EASY * 3)[1] == 1 and profile(HARD * 3)[1] == 4
    assert profile((EASY * 3).upper())[1] == 1
    assert profile(EASY * 8 + "\n\n" + HARD)[1] == 1 and profile(EASY + "\n\n" + HARD * 8)[1] == 4
    for none in [None, "", " \n", "793.tif", "12-3 44-5", "District|Lot area\nR-1|5,000", "Sec. 15-27. Yards. ......... 35", "La ordenanza permite construir una vivienda adicional en el distrito cuando el terreno mide más.", "Das Bauamt muss innerhalb von vier Wochen über den Antrag entscheiden."]:
        assert profile(none)[1] is None, none
    assert profile("Utilization remain exclusively environmental. Procedural authorization necessitate entitlements.")[1] == 4


def test_tables_with_nulls_repeats_and_long_texts(spark):
    rows = [(1, EASY, 7), (1, EASY, 7), (2, None, 7), (None, HARD, 7), (3, HARD * 2000, 7)]
    out = reading_levels(spark.createDataFrame(rows, "doc_id bigint, text string, band int")).collect()
    assert sorted((r["doc_id"] or -1, r["band"] or 0) for r in out) == [(-1, 4), (1, 1), (1, 1), (2, 0), (3, 4)]
    assert [r["english_sentences"] for r in out if r["doc_id"] == 3] == [2000]
    assert reading_levels(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_bands_in_the_jvm_are_those_of_the_profile(spark):
    texts = [EASY * 3, HARD * 3, EASY * 2 + "\n\n" + HARD * 2, "", None, "12-3", EASY + "\n\n" + HARD * 8, (EASY + HARD) * 40]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in reading_levels(rows).collect():
        grade, band, words, n, by = profile(texts[r["doc_id"]])
        assert (r["band"], r["english_words"], r["english_sentences"], r["words_by_band"]) == (band, words, n, by)
        assert r["grade"] == pytest.approx(grade)


def test_cuts_are_fitted_where_there_are_labels(spark):
    docs = spark.createDataFrame([(i, EASY * 3 if i % 2 else HARD * 3) for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 3 if i % 2 else 4, "a") for i in range(40)] + [(0, 3, "b"), (None, 1, "b")], "doc_id bigint, band int, rater string")
    graded = graded_documents(docs)
    cuts = fit_cuts(graded, labels)
    assert cuts[:2] == CUTS[:2] and cuts[2] >= cuts[1] and profile(HARD * 3, cuts)[1] == 4
    assert fit_cuts(graded, labels.limit(0)) == CUTS
    assert {tuple(r) for r in fitted_levels(docs, labels).select("doc_id", "band").collect()} == {(i, 3 if i % 2 else 4) for i in range(40)} or cuts[2] > cuts[1]


def test_held_out_accuracy(spark):
    docs, labels = [spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "reading_label")]
    learn, hold = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    agreed = hold.groupBy("doc_id").agg(F.min("band").alias("want"), F.max("band").alias("most")).where("want = most")
    got = reading_levels(docs.join(agreed.select("doc_id"), "doc_id", "left_semi"), fit_cuts(graded_documents(docs), learn)).join(agreed, "doc_id").collect()
    right = sum(r["band"] == r["want"] for r in got) / len(got)
    assert len(got) > 150 and right > 0.93, right
