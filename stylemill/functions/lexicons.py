"""Marker vocabularies. All are parameters of the operators; these are the defaults."""

from __future__ import annotations

# The terms that the measurements are defined by.
FUNCTION_WORDS = (
    "the a an and or but if then because so while although though of in on for with as by from to into over under "
    "between is are was were be been being it this that these those i we you he she they me us him her them my our "
    "your their not no nor very also even only just rather however therefore"
).split()
STOP_WORDS = (
    "the a an and or but if then to of in on for with as is are was were be been it that this these those i you he "
    "she they we me him her them my your our their at by"
).split()
# Where a text is held against a profile, its own n-grams have a shorter list, and three marks are not counted.
RATED_STOP_WORDS = "the a an and or but if then to of in on for with as".split()
UNRATED = {"punctuation": ["hyphen_dashes", "quotes_double", "quotes_single"]}
STANCE = {
    "hedge": "may might perhaps likely possibly seems appears suggests tends".split(),
    "booster": "clearly obviously certainly undoubtedly indeed surely".split(),
    "directive": "must should need needs ought required".split(),
    "first_person": "i me my mine we us our ours".split(),
    "second_person": "you your yours".split(),
    "third_person": "he him his she her hers they them their theirs".split(),
}
EPISTEMIC = {
    "speculative": "may might perhaps possibly could seems appears suggests tends".split(),
    "probabilistic": "likely unlikely probable probably odds chance".split(),
    "assertive": "clearly certainly undoubtedly indeed surely".split(),
    "directive": "must should need needs ought required".split(),
}
SUBORDINATORS = "because although though while if when since unless whereas after before once until".split()
AVOIDANCE = {
    "intensifiers": "very really extremely highly incredibly quite so".split(),
    "emotional_adjectives": "happy sad angry afraid anxious excited terrible wonderful awful lovely".split(),
    "informal_slang": "cool awesome yeah ok okay stuff gonna wanna kinda sorta".split(),
}
TRANSITIONS = [
    "however", "therefore", "moreover", "furthermore", "nevertheless", "nonetheless", "for example", "for instance",
    "in short", "in sum", "in practice", "in effect", "first", "second", "third", "finally", "overall",
]
RHETORIC = {
    "claim": ["we argue", "we contend", "we propose", "this suggests", "this shows", "this indicates", "therefore", "thus", "hence", "overall", "in sum"],
    "evidence": ["for example", "for instance", "according to", "data show", "evidence", "study", "report", "survey", "as shown"],
    "counterpoint": ["however", "yet", "but", "on the other hand", "nevertheless", "nonetheless"],
    "concession": ["although", "though", "even though", "while", "granted", "admittedly"],
    "synthesis": ["overall", "in sum", "in short", "on balance", "taken together", "in conclusion"],
}
PUNCTUATION = {
    "commas": ",", "semicolons": ";", "colons": ":", "exclamations": "!", "questions": "?", "parentheses_open": "(",
    "parentheses_close": ")", "em_dashes": "—", "en_dashes": "–", "hyphen_dashes": " - ", "ellipses_unicode": "…",
    "ellipses_three_dots": "...", "quotes_double": '"', "quotes_single": "'",
}
SPELLING_PAIRS = [
    ("color", "colour"), ("favor", "favour"), ("honor", "honour"), ("labor", "labour"), ("neighbor", "neighbour"),
    ("center", "centre"), ("theater", "theatre"), ("fiber", "fibre"), ("liter", "litre"), ("meter", "metre"),
    ("check", "cheque"), ("defense", "defence"), ("offense", "offence"), ("license", "licence"),
    ("practice", "practise"), ("program", "programme"),
]
REFERENCE_HEADINGS = ["references", "bibliography", "works cited", "citations", "sources", "endnotes", "footnotes", "notes"]
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
SENTENCE_BINS = [(0, 9), (10, 17), (18, 25), (26, 40), (41, None)]
PARAGRAPH_BINS = [(1, 1), (2, 3), (4, 5), (6, 8), (9, None)]
SIMILARITY_WEIGHTS = {
    "function_words_distribution": 0.20, "sentence_histogram": 0.15, "paragraph_histogram": 0.10, "punctuation_rates": 0.10,
    "stance_signals": 0.08, "rhetoric_moves": 0.08, "syntax_texture": 0.08, "paragraph_cadence": 0.08, "repetition": 0.05,
    "lexicon_preferred_overlap": 0.04, "lexicon_avoid_overlap": 0.04,
}

#: Everyday words whose absence from a corpus is worth knowing, most frequent first. Our own choice; a parameter.
COMMON_WORDS = "time people year way day man thing woman life child world school state family student group country problem hand part place case week company system question work government number night point home water room mother area money story fact month lot right study book eye job word".split()
