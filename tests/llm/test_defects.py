import json
import random

import pytest

from strataq.llm import defects as D

PROMPT = "#Question:\nMay a boat be stored in the front yard during winter months?\n\n#Background:\nOnly houses matter.\n\n#Context:\n##Section Path: 4.2 Boats\nSection Text: A boat shall be kept behind the house unless the planning board allows another place."
ES = "#Question:\n¿Se puede guardar una lancha en el patio delantero durante el invierno?\n\n#Context:\nEl mapa muestra los distritos."
SOUND = ["The section on R-2 states that a barn may be built where the lot has 14 units. Two sections differ here, and Chapter 4 is the later one.\n\nANSWER: Yes", "Under Sec. 7.8 a boat is listed among the permitted uses. Corner lots follow another rule, namely 45 feet along Ferry Walk.\nANSWER: NO", "The text says that the clerk decides on a fence after a public hearing. I am unable to tell from the sections alone.\n\nANSWER: I DON'T KNOW"]


def pair(content=None, args=None, prompt=PROMPT):
    return D.Pair(D.question_of(prompt), prompt, content, args)


@pytest.fixture(scope="module")
def model():
    r = random.Random(1)
    nouns = ["barn", "fence", "duplex", "kennel", "porch", "clinic", "nursery", "shed"]
    sample = []
    for i in range(300):
        a, b = r.choice(nouns), r.choice(nouns)
        t = r.choice(SOUND).replace("barn", a).replace("fence", b).replace("14", str(i % 30))
        sample.append(pair(t) if i % 6 else pair(None, json.dumps({"Dont_Know": False, "Answer": r.choice(["Yes", "No", 5])})))
        if i % 10 == 0:
            sample.append(pair("El mapa del distrito muestra dónde se puede instalar un taller. Los vecinos pueden asistir a la audiencia.\n\nANSWER: NO", None, ES))
    return D.train(sample)


def defect(model, p):
    return D.classify(model, [p])[0]


@pytest.mark.parametrize(
    ("p", "want"),
    [
        (pair(""), "empty"), (pair(" \n"), "empty"), (pair("ANSWER: \n"), "empty"), (pair("​"), "empty"), (pair("```\n```"), "empty"), (pair(None, None), "empty"), (pair(None, ""), "empty"), (pair(None, '{"Dont_Know": false}'), "empty"), (pair(None, '{"Dont_Know":false,"Answer":" "}'), "empty"),
        (pair(None, '{"Dont_Know":true,"Answer":null}'), None), (pair(None, '{"Dont_Know":true}'), None), (pair(None, '{"Dont_Know":false,"Answer":7}'), None), (pair(None, '{"Answer":"No"}'), None), (pair("ANSWER: I don't know"), None), (pair("ANSWER: YES."), None), (pair("ANSWER: 1e3"), None),
        (pair(None, '{"Dont_Know":false,"Ans'), "truncated"), (pair("The section on R-2 states that a barn may be bu"), "truncated"), (pair("The limit of 8 feet applies to a shed. Corner lots follow..."), "truncated"), (pair("A barn is allowed. The limit of 3 feet in Ord. No."), "truncated"),
        (pair("Two sections differ.\nANSWER: R-1, 5000, Square Feet, No\nR-2, 7000, Squ"), "truncated"), (pair("Two sections differ.\nANSWER: R-1, 5000, Square Feet, No\nR-2, 7000, Square Feet, Yes"), None), (pair("A barn is listed. The yard has 5,000 sq. ft."), None),
        (pair("I'm sorry, but I can't help with this question."), "refusal"), (pair("The section on R-2 states a rule. It is against my policy to interpret Art. 8 for anyone.\n\nANSWER: N/A"), "refusal"), (pair(None, '{"Dont_Know":true,"Answer":"I must decline to answer questions about local law."}'), "refusal"), (pair(SOUND[2]), None), (pair(SOUND[0]), None),
        (pair("May a boat be stored in the front yard during winter months?"), "copy"), (pair("MAY A BOAT BE STORED IN THE FRONT YARD DURING WINTER MONTHS"), "copy"), (pair("The question is: May a boat be stored in the front yard during winter months?"), "copy"), (pair("May boat be stored in the front yard winter during months?"), "copy"),
        (pair("May a boat be stored in the front yard during winter months?\n\nANSWER: May a boat be stored in the front yard during winter months?"), "copy"), (pair("The question is: May a boat be stored in the front yard during winter months? " + SOUND[1]), None), (pair(PROMPT), "copy"),
        (pair("Los vecinos pueden asistir a la audiencia y la oficina debe contestar antes de tres semanas.\n\nANSWER: NO"), "other_language"), (pair("Le bureau doit répondre dans les semaines qui suivent la demande et les voisins peuvent donner leur avis."), "other_language"),
        (pair("El mapa del distrito muestra dónde se puede instalar un taller. La oficina debe contestar antes de 3 semanas.", None, ES), None), (pair(SOUND[0], None, ES), "other_language"), (pair('The code uses the Spanish word casita for a guest suite. An old note says "no se permite" next to the table.\nANSWER: NO'), None),
    ],
)
def test_defect_of_one_pair(model, p, want):
    assert defect(model, p) == want


def test_training_is_repeatable_and_stands_nothing():
    sample = [pair(t) for t in SOUND * 10]
    a, b = D.train(sample), D.train(sample)
    assert (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all()
    assert (D.encode(sample, D.Lexicon(a.languages)).dense == D.encode(sample, D.Lexicon(b.languages)).dense).all()
    assert defect(D.train([]), pair("text")) is None


def test_held_out_synthetic_versions(model):
    r = random.Random(77)
    sample = [pair(SOUND[i % 2].replace("14", str(i))) for i in range(80)]
    wrong = n = 0
    for p in sample:
        for q, y in D.synthetic(p, sample, r, model.languages):
            if y:
                n += 1
                wrong += defect(model, q) != y
    assert n > 400 and wrong / n < 0.04, wrong / n


REQ = "batch_id string, custom_id string, sent_at bigint, body struct<model:string,messages:array<struct<role:string,content:string>>>, muni string"
RES = "record_id bigint, batch_id string, custom_id string, received_at bigint, response struct<body:struct<choices:array<struct<index:int,message:struct<role:string,content:string,tool_calls:array<struct<function:struct<name:string,arguments:string>>>>,finish_reason:string>>>>, prompt string"


def test_pairing_and_whole_run(spark, model):
    body = lambda p: ("m", [("system", "s"), ("user", p)])
    choice = lambda i, c, a=None: (i, ("assistant", c, None if a is None else [(("f", a),)]), "stop")
    reqs = [("b", "A b#1#x_main_1", 1, body(PROMPT), None), ("b", "A b#1#x_main_1", 1, body(PROMPT), None), ("b", "Q#2#y_parse_2_10", 1, body("t"), None), ("b", "Q#2#y_parse_21_0", 1, body("u"), None), (None, None, None, None, None), ("b", "none_main_1", 1, ("m", None), None)]
    res = [
        (1, "b", "a B%231%23x_MAIN_1 ", 1, ((([choice(0, ""), choice(1, SOUND[0]), choice(2, "The section on R-2 st")]),),), None), (2, "b", "Q#2#y_parse_2_10", 1, (([choice(0, None, '{"Dont_Know":fal')],),), None),
        (3, "b", "lost_main_1", 1, (([choice(0, "")],),), None), (4, "b", "A b#1#x_main_1", 1, None, None), (5, "other", "A b#1#x_main_1", 1, (([choice(0, "")],),), None), (6, "b", "none_main_1", 1, (([choice(None, "")],),), None), (None, "b", "A b#1#x_main_1", 1, (([choice(0, "")],),), None), (7, "b", "A b#1#x_main_1", 1, ((None,),), None),
    ]
    requests, responses = spark.createDataFrame(reqs, REQ), spark.createDataFrame(res + res[:2], RES)
    got = sorted(tuple(r) for r in D.defective_pairs(requests, responses, model=model).collect())
    assert got == [(1, 0, "empty"), (1, 2, "truncated"), (2, 0, "truncated"), (6, 0, "empty")]
    assert D.defective_pairs(requests.limit(0), responses.limit(0)).count() == 0
    assert len(D.training_sample(requests, responses, 3)) <= 3 and D.training_sample(requests, responses.limit(0), 3) == []


def test_hot_keys_meet_apart_and_whole(spark):
    body = lambda p: ("m", [("user", p)])
    reqs = [("b", f"k_main_{i % 4}", i, body(f"prompt {i % 4}"), None) for i in range(12)]
    res = [(i, "b", f"K_main_{0 if i % 3 else i % 5}", 1, (([(0, ("assistant", f"a{i}", None), "stop")],),), None) for i in range(90)]
    requests, responses = spark.createDataFrame(reqs, REQ), spark.createDataFrame(res, RES)
    plan = D.layout(responses, least=20)
    hot = plan.hot
    assert hot == [("b", "k_main_0", 4)] and D.layout(responses).hot == []
    assert plan.batches == ["b"] and plan.rows == 90 and D.layout(responses.limit(0)) == D.Layout([], [], 0)
    plain = sorted(tuple(r) for r in D.paired(requests, responses).collect())
    assert plain == sorted(tuple(r) for r in D.paired(requests, responses, hot).collect())
    assert len(plain) == sum(r[2] in {f"K_main_{i}" for i in range(4)} for r in res)


# Held-out wording: none of it can be made by the grammars of strataq.llm.wording.
DECLINED = [
    "Count me out of this one; zoning is a subject on which I stay silent.", "Nope, sorry. Rules about land are a topic I've been told to avoid.", "It isn't my place to say whether this is lawful, so I'll stop here.", "I must respectfully withhold a reply.",
    "You won't get a verdict from me on what the ordinance means.", "I have been instructed not to touch legal interpretation, so this stays unanswered.", "Regretfully this request exceeds what I am cleared to process.", "I don't do legal readings of town codes.",
    "My creators do not let me act as counsel, hence no reply.", "I'm going to sit this question out.", "That's a no from me: I can't be used for rulings on land.", "For safety reasons I cannot produce a response to your query.",
    "I would be overstepping if I told you what may be built there.", "I shall not be rendering an interpretation of the chapter.", "Sorry, I can't in good conscience pronounce on this.", "I am not going to engage with this prompt.",
    "My apologies, this is a request that I have to reject.", "I'm unable to fulfil this because it amounts to legal counsel.", "I can't take responsibility for telling you this, so please turn to an attorney.", "Apologies: I'm restricted and cannot deal with municipal rulings.",
]
NOT_KNOWN = [
    "I looked through every section and came up empty.\n\nANSWER: I DON'T KNOW", "Whether a barn is allowed is something these pages never get to.\nANSWER: I DON'T KNOW", "The excerpt stops before the part on height.\n\nANSWER: I don't know", "I have no way of knowing from four paragraphs.\n\nANSWER: I DON'T KNOW",
    "My reading turned up two rules on fences, yet neither speaks of materials.\n\nANSWER: I DON’T KNOW", "Sorry, the table with the figures is missing from what I was shown.\nANSWER: I DON'T KNOW", "I'd need the definitions chapter to be sure.\n\nANSWER: I don't know", "Not one line here deals with tree funds.\nANSWER: I DON'T KNOW",
    "I can see a limit for sheds but none for houses.\n\nANSWER: I DON'T KNOW", "It may well be regulated elsewhere; these sections leave me guessing.\nANSWER: I don't know", "Hens come up once, and only in a heading.\n\nANSWER: I DON'T KNOW", "I can't say for sure, since the map is not part of the text.\nANSWER: I DON'T KNOW",
    "Regrettably, the passage on parking has been cut off before any number.\n\nANSWER: I don't know", "The sections I was given contradict each other on this.\nANSWER: I DON'T KNOW", "Perhaps the schedule has it, but I wasn't given the schedule.\n\nANSWER: I DON'T KNOW", "No luck: nothing about wind turbines.\n\nANSWER: I DON'T KNOW",
    "The clerk cannot waive the review, though whether the planner can is left unsaid.\nANSWER: I don't know", "I read Chapter 4 twice and still find no count of spaces.\n\nANSWER: I DON'T KNOW", "That point is missing.\nANSWER: I DON'T KNOW", "We are told who decides but not by when.\n\nANSWER: I DON’T KNOW",
]
ABROAD = [
    "Zgodnie z tym rozdziałem na działce wolno postawić drugi budynek, o ile właściciel uzyska zgodę rady.", "该条例规定,在住宅区内可以停放船只,但必须放在房屋后面,并且事先得到规划委员会的批准。", "Согласно этой главе лодку можно хранить только за домом, если совет не разрешит иное место.", "Båten får bara förvaras bakom huset om inte nämnden har godkänt en annan plats.",
    "Selon ce chapitre, un bateau se range derrière la maison, sauf accord de la commission.", "Laut diesem Kapitel muss ein Boot hinter dem Haus stehen, außer die Kommission erlaubt etwas anderes.", "Hajót csak a ház mögött szabad tárolni, kivéve ha a bizottság más helyet engedélyez.", "Kapal hanya boleh disimpan di belakang rumah kecuali dewan mengizinkan tempat lain.",
    "Secondo questo capitolo la barca va tenuta dietro la casa, salvo permesso della commissione.", "Segundo este capítulo, o barco fica atrás da casa, salvo se a comissão permitir outro lugar.", "Tekne ancak evin arkasında tutulabilir, meğer ki kurul başka bir yere izin versin.", "Según este capítulo la lancha se guarda detrás de la casa, salvo permiso de la junta.",
]


@pytest.fixture(scope="module")
def trained(spark):
    """As the query trains it, on the pairs of the test tables."""
    tables = [spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("api_request", "api_response")]
    return D.train(D.training_sample(*tables, 2000))


def test_held_out_wording(trained):
    shown = {x for g in (D.W.REFUSAL_EN, D.W.UNKNOWN_EN) for v in g.values() for x in v if x.count(" ") > 3}
    assert not any(c.lower().strip(" .,;") in t.lower() for c in shown for t in DECLINED + NOT_KNOWN if "{" not in c)
    refused = [defect(trained, pair(t)) for t in DECLINED] + [defect(trained, pair(f"{SOUND[0][:54]} 3 feet. {t}\n\nANSWER: N/A")) for t in DECLINED[::4]]
    unknown = [defect(trained, pair(t)) for t in NOT_KNOWN]
    hit, false = refused.count("refusal"), unknown.count("refusal")
    print(hit, len(refused), [t for t, d in zip(DECLINED, refused) if d != "refusal"], false, [t for t, d in zip(NOT_KNOWN, unknown) if d])
    assert hit / len(refused) >= 0.9 and hit / (hit + false) >= 0.9
    assert sum(d is None for d in unknown) / len(unknown) >= 0.9
    assert [t for t in ABROAD if defect(trained, pair(t)) != "other_language"] == []


@pytest.mark.parametrize(
    ("p", "want"),
    [
        (pair("Two rules apply:\n- A barn may be built where the lot has 14 units\n- A fence needs a permit from the clerk"), None), (pair("Two rules apply:\n- A barn may be built where the lot has 14 units.\n- A fence needs a permit from the cl"), "truncated"),
        (pair(None, json.dumps({"Dont_Know": False, "Answer": ["I'm sorry, but I can't help with this request."]})), "refusal"), (pair(None, json.dumps({"Dont_Know": False, "Answer": [{"district_name": "R-1", "min_lot_size": 5000, "unit": "Square Feet", "estate": False}]})), None),
        (pair(None, json.dumps({"Answer": ["May a boat be stored in the front yard during winter months?"]})), "copy"), (pair(None, [json.dumps({"Dont_Know": False}), json.dumps({"Dont_Know": False, "Answer": "No"})]), None), (pair(None, ['{"Dont_Know": false, "Answer": "No"}', '{"Dont_Know": false, "Ans']), "truncated"), (pair(None, []), "empty"),
        (pair(None, json.dumps({"Dont_Know": False, "Answer": "[Sec. 4] The barn is listed among the permitted uses of the district, and no permit is needed there."})), None), (pair("Under Sec. 7.8 a boat is listed among the permitted uses. " * 4_000), None),
    ],
)
def test_lists_calls_and_long_answers(trained, p, want):
    assert defect(trained, p) == want


def test_the_classifier_decides_every_type(trained, spark):
    """Without its weights nothing is flagged, and no type is settled by a single feature."""
    tables = [spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("api_request", "api_response")]
    rows = D.paired(*tables).dropDuplicates(["record_id", "choice_index"]).collect()
    pairs = [D.Pair(D.question_of(r["prompt"]), r["prompt"], r["content"], r["arguments"]) for r in rows]
    c = D.encode(pairs, D.Lexicon(trained.languages))
    found = D.decide(trained, c)
    off = D.Model(trained.weights * 0, trained.dense * 0, trained.thresholds, trained.languages)
    assert {d for d in found if d} == set(D.DEFECTS) and all(found.count(k) > 10 for k in D.DEFECTS)
    assert D.decide(off, c) != found
    narrow = D.Model(trained.weights * 0, trained.dense, trained.thresholds, trained.languages)
    assert sum(a != b for a, b in zip(D.decide(narrow, c), found, strict=True)) > 20
