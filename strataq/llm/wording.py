"""Synthetic wording: refusals, don't-knows and near refusals made from small grammars, to train the classifier of defects.

The grammars follow the ways in which one can decline (inability, permission, preference, policy, scope) and in which a text
can leave a question open; they hold no answers of any data set.
"""

from __future__ import annotations

import random
import re

SLOT = re.compile(r"\{(\w+)\}")

REFUSAL_EN = {
    "start": ["{open}{core}.", "{open}{core}.", "{open}{core}. {close}", "{close} {open}{core}.", "{open}{core}. {Core}."],
    "open": ["", "", "", "Sorry, ", "I'm sorry, but ", "I’m sorry, but ", "I am sorry; ", "Unfortunately, ", "Regrettably, ", "My apologies, but ", "I apologize, but ", "I'm afraid ", "I am afraid that ", "As an AI, ", "As an AI language model, ", "As an assistant, ", "Being a virtual assistant, ", "Thanks for asking, but ", "Thank you for the material, however ", "Having seen the request, ", "With all respect, ", "To be plain, "],
    "core": ["I {cannot} {do} {x}", "I {cannot} {do} {x}", "I {cannot} {whole}", "I {barred} {doing} {x}", "{x} {beyond} {limits}", "{doing} {x} {breaks} {rules}", "it {unfit} for me to {do} {x}", "{x} is not something {able}", "{doing} {x} is not something {able}", "my {ruleset} {forbid} {doing} {x}", "I {skip} {x}", "I {rather} {x} to {expert}", "no {comment} {made} by me on {x}", "it {isagainst} {rules} to {do} {x}", "{x} {isagainst} {rules}"],
    "Core": ["I {cannot} {do} {x}", "It {unfit} for me to {do} {x}", "My {ruleset} {forbid} {doing} {x}", "This {beyond} {limits}"],
    "cannot": ["can't", "can’t", "cannot", "am unable to", "'m unable to", "am not able to", "'m not able to", "won't", "will not", "won't be able to", "must decline to", "have to decline to", "decline to", "refuse to", "would rather not", "'d rather not", "prefer not to", "choose not to", "am not in a position to", "am not permitted to", "am not allowed to", "am not authorized to", "do not wish to", "may not", "have no authority to"],
    "do": ["help with", "assist with", "answer", "respond to", "reply to", "comment on", "discuss", "advise on", "give advice on", "give an opinion on", "offer an opinion on", "weigh in on", "take a position on", "interpret", "judge", "provide guidance on", "provide an answer to", "provide", "share a view on", "carry out", "complete", "fulfil", "comply with", "take on", "do", "go into"],
    "whole": ["help", "assist", "do that", "answer", "comply", "respond", "continue with this", "take part in this", "be of help here", "provide that information"],
    "doing": ["answering", "commenting on", "discussing", "judging", "interpreting", "advising on", "giving a view on", "giving an opinion on", "helping with", "responding to", "replying to", "providing", "speaking about"],
    "barred": ["am not comfortable", "don't feel comfortable", "do not feel at ease", "am going to refrain from", "will refrain from", "must refrain from", "have to abstain from", "am barred from", "am prevented from", "am restricted from", "am kept from", "want to avoid", "will stay away from"],
    "beyond": ["falls outside", "is outside", "lies beyond", "is beyond", "goes beyond", "is not within"],
    "limits": ["what I can do", "what I may discuss", "what I am permitted to do", "what I am allowed to treat", "my scope", "my role", "my remit", "my abilities", "the things that I can help with", "the limits that I work under"],
    "breaks": ["would go against", "would violate", "would break", "goes against", "conflicts with", "is not allowed by", "is ruled out by", "would run counter to"],
    "rules": ["my guidelines", "my rules", "my policies", "the rules that I follow", "the guidelines that bind me", "my instructions", "my policy", "the terms under which I work"],
    "ruleset": ["guidelines", "rules", "policies", "instructions", "policy", "settings"],
    "forbid": ["keep me from", "prevent me from", "prohibit me from", "stop me from", "do not allow", "don't permit", "rule out"],
    "isagainst": ["is against", "goes against", "would be against"],
    "unfit": ["is not appropriate", "would not be appropriate", "would be inappropriate", "isn't proper", "wouldn't be right", "is not possible", "is not acceptable", "would be improper"],
    "able": ["I can do", "I am able to do", "I'm allowed to do", "I will do", "I may do", "that I can offer", "I am willing to do"],
    "skip": ["have to pass on", "must pass on", "will have to pass on", "am going to skip", "will leave aside", "have to set aside", "must turn down", "have to turn down"],
    "rather": ["would rather leave", "'d rather leave", "must leave", "will leave", "have to hand"],
    "expert": ["an expert", "a lawyer", "someone qualified", "a professional", "the proper office", "counsel"],
    "comment": ["comment", "opinion", "advice", "answer", "view", "statement"],
    "made": ["can be made", "can be given", "will be given", "will be offered", "may be offered"],
    "close": ["Please consult a lawyer.", "Please ask an attorney.", "Please contact the planning office instead.", "You may want to ask the town hall.", "You should speak with a qualified professional.", "An expert on {x} can advise you.", "I am happy to help with something else.", "If there is anything else, I'd be glad to help.", "Is there another task for me?", "This calls for legal advice.", "It asks for a professional judgement.", "The request may involve private matters.", "The content might be sensitive."],
    "x": ["this", "that", "it", "this question", "your question", "this request", "the request", "this task", "the matter", "this one", "such questions", "local law", "zoning rules", "the ordinance", "land use law", "the code", "a permit", "legal matters", "legal questions", "Sec. 12-4", "Ord. No. 88", "Art. 3", "what may be built in R-1", "private property"],
}
REFUSAL_ES = {
    "start": ["{open}{core}.", "{open}{core}.", "{open}{core}. {close}", "{Open}{core}. {close}"],
    "open": ["", "", "Lo siento, ", "Lo siento, pero ", "Lamentablemente, ", "Disculpe, pero ", "Me temo que ", "Como asistente, ", "Como modelo de lenguaje, ", "Gracias por la pregunta, pero "],
    "Open": ["", "Con todo respeto, ", "Por desgracia, "],
    "core": ["{no} {hacer} {x}", "{no} {hacer} {x}", "{x} {fuera} {limite}", "{hacer} {x} {contra}", "{no} {todo}"],
    "no": ["no puedo", "no podré", "no me es posible", "no estoy en condiciones de", "no estoy autorizado a", "no tengo permiso para", "no se me permite", "prefiero no", "debo abstenerme de", "tengo que negarme a", "debo negarme a", "no deseo", "no voy a", "tengo que rechazar", "no quisiera", "me niego a"],
    "hacer": ["ayudar con", "responder a", "contestar", "opinar sobre", "comentar", "dar consejo sobre", "dar una opinión sobre", "dar asesoramiento sobre", "hablar de", "interpretar", "atender", "tratar"],
    "todo": ["ayudar", "ayudarle con eso", "responder", "contestar", "hacer eso", "seguir con esto", "opinar"],
    "fuera": ["queda fuera de", "está fuera de", "va más allá de"], "limite": ["lo que puedo hacer", "lo que puedo tratar", "mis funciones", "mi alcance", "lo que se me permite"],
    "contra": ["va en contra de mis reglas", "no es algo que yo pueda hacer", "sería contrario a mis normas", "no me corresponde"],
    "close": ["Consulte a un abogado.", "Hable con la oficina municipal.", "Pregunte a un profesional.", "¿Puedo ayudarle en otra cosa?"],
    "x": ["esto", "eso", "esta pregunta", "esa pregunta", "esta solicitud", "este asunto", "la ordenanza", "la ley local", "temas legales", "un asunto legal", "el código"],
}
REFUSAL_OTHER = {
    "start": ["{fr}.", "{fr}.", "{de}.", "{de}.", "{pt}.", "{it}.", "{nl}."],
    "fr": ["{frs}je ne peux pas {frv}", "{frs}je ne suis pas autorisé à {frv}", "{frs}je préfère ne pas {frv}", "{frs}il m'est impossible de {frv}", "{frs}je dois refuser de {frv}"], "frs": ["", "Désolé, ", "Malheureusement, ", "Je regrette, mais "], "frv": ["vous aider", "répondre à cette question", "donner un avis juridique", "traiter cette demande", "commenter ce règlement"],
    "de": ["{des}ich kann {dev}", "{des}ich darf {dev}", "{des}ich möchte {dev}"], "des": ["", "Leider gilt: ", "Es tut mir leid, ", "Entschuldigung, "], "dev": ["diese Frage nicht beantworten", "dazu keine Auskunft geben", "dabei nicht helfen", "keinen Rechtsrat erteilen", "diese Anfrage nicht bearbeiten"],
    "pt": ["{pts}não posso {ptv}", "{pts}não tenho permissão para {ptv}", "{pts}prefiro não {ptv}"], "pts": ["", "Desculpe, ", "Infelizmente, "], "ptv": ["ajudar com isto", "responder a esta pergunta", "dar uma opinião jurídica", "atender este pedido"],
    "it": ["{its}non posso {itv}", "{its}preferisco non {itv}"], "its": ["", "Mi dispiace, ", "Purtroppo "], "itv": ["aiutare con questo", "rispondere a questa domanda", "dare un parere legale"],
    "nl": ["{nls}ik kan {nlv}", "{nls}ik mag {nlv}"], "nls": ["", "Sorry, ", "Helaas, "], "nlv": ["hier niet bij helpen", "deze vraag niet beantwoorden", "geen juridisch advies geven"],
}
UNKNOWN_EN = {
    "start": ["{open}{core}.", "{open}{core}.", "{core}, {regret}."],
    "open": ["", "", "", "Unfortunately, ", "Sorry, ", "I'm sorry, but ", "I am afraid ", "Having read all of it, ", "From what is given, "], "regret": ["sorry to say", "I am afraid", "unfortunately", "as far as I can see"],
    "core": ["I {couldnt} {find} {x} {where}", "I {couldnt} {tell} {where}", "{source} {silent}", "{source} {doesnt} {x}", "it is {unclear} {where}", "it {cannotbe} {where}", "there is no {rule} {x} {where}", "no {part} {settles} {x}", "I found no {rule} {x}", "I do not know", "nothing {where} {settles} {x}", "{source} {doesnt} enough to {tell2}"],
    "couldnt": ["can't", "cannot", "can’t", "could not", "couldn't", "am unable to", "am not able to", "was unable to", "was not able to"], "find": ["find", "see", "locate", "find any mention of", "find a rule on", "make out", "identify"], "tell": ["tell", "say", "determine this", "determine it", "settle this", "be certain", "answer this", "find out", "decide this"], "tell2": ["answer", "decide", "tell", "settle this"],
    "source": ["the sections", "the text", "the context", "the excerpts", "the passages", "the material"], "silent": ["do not say", "does not say", "give no answer", "is silent on this", "are silent here", "cannot settle this", "leaves it open", "do not go into this"], "doesnt": ["do not mention", "does not mention", "don't cover", "doesn't address", "do not give", "say nothing about", "hold nothing on"],
    "where": ["in the sections", "from the sections", "in the text", "from the context", "from these passages", "from what is given", "from the excerpts alone", "in the material", "here"], "unclear": ["unclear", "not stated", "not possible to tell", "impossible to say", "left open", "not clear"], "cannotbe": ["cannot be determined", "can't be told", "cannot be settled", "could not be established"],
    "rule": ["rule on", "mention of", "information about", "statement about", "figure for", "provision on"], "part": ["section", "passage", "rule", "part of the text", "chapter"], "settles": ["mentions", "covers", "answers", "settles", "speaks of", "allows an answer on"],
    "x": ["this", "it", "that", "the matter", "such a rule", "the answer", "the number", "this point", "the height", "a fence", "a barn", "parking", "the district", "such a use"],
}
UNKNOWN_ES = {
    "start": ["{core}.", "{core}.", "{open}{core}."], "open": ["Por desgracia, ", "Lamentablemente, ", "Lo siento, pero "],
    "core": ["{fuente} no {dice}", "no {puedo} {donde}", "no se {sabe} {donde}", "no hay {regla} sobre esto"], "fuente": ["las secciones", "el texto", "el contexto"], "dice": ["lo dicen", "lo dice", "lo aclara", "responde a esto", "menciona esto", "permiten saberlo"],
    "puedo": ["puedo determinarlo", "puedo saberlo", "encuentro nada", "pude encontrarlo", "puedo decidirlo"], "sabe": ["puede saber", "menciona", "indica", "puede determinar"], "donde": ["con las secciones dadas", "en el texto", "en las secciones", "con lo dado"], "regla": ["ninguna regla", "información", "nada"],
}
# Sound sentences in which somebody else declines or may not do a thing.
NEAR_EN = {
    "start": ["{who} {cannot} {do} {x}{why}."], "who": ["The office", "The clerk", "The town clerk", "The board", "An applicant", "The owner", "A builder", "The council", "The commission", "The inspector", "A tenant"],
    "cannot": ["cannot", "is not able to", "is unable to", "may refuse to", "may decline to", "will not", "is not permitted to", "is not allowed to", "must refuse to", "declined to", "is asked to refrain from to"], "do": ["help with", "answer", "comment on", "approve", "issue", "assist with", "give advice on", "proceed with", "discuss"],
    "x": ["private disputes", "a permit for a shed", "such requests", "a second house", "the plan", "questions about fences", "an incomplete application"], "why": ["", "", " without a hearing", ", as Sec. 4.2 says", " when the yard is too small", " under this chapter"],
}
TAIL_EN = ["", "", "", "\n\nANSWER: N/A", "\n\nANSWER: I cannot answer this.", "\n\nANSWER: I won't say.", "\nANSWER: NONE", "\n\nANSWER: I decline."]
TAIL_ES = ["", "", "", "\n\nANSWER: N/A", "\n\nRESPUESTA: N/A", "\n\nRESPUESTA: no puedo responder."]
UNKNOWN_TAIL = ["\n\nANSWER: I DON'T KNOW", "\nANSWER: I don't know", " ANSWER: I DON’T KNOW", "", "", "\n\nANSWER: UNKNOWN"]


def make(grammar: dict[str, list[str]], r: random.Random, symbol: str = "start") -> str:
    """One sentence or more of a grammar, each beginning with a capital."""
    text = SLOT.sub(lambda m: make(grammar, r, m.group(1)), r.choice(grammar[symbol]))
    if symbol != "start":
        return text
    text = text.replace("I '", "I'").strip()
    return re.sub(r"(^|[.?!] )([^\W\d_])", lambda m: m.group(1) + m.group(2).upper(), text)
