"""Fixed values that results depend on."""

# English stop words.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down "
    "during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my "
    "myself no nor not now of off on once only or other our ours ourselves out over own per same she should so some such t than that the their theirs them "
    "themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you "
    "your yours yourself yourselves s d ll m o re ve y ma"
).split()
# States that make the end of a postal address.
STATES = (
    "al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy dc "
    "alabama alaska arizona arkansas california colorado connecticut delaware florida georgia hawaii idaho illinois indiana iowa kansas kentucky louisiana "
    "maine maryland massachusetts michigan minnesota mississippi missouri montana nebraska nevada ohio oklahoma oregon pennsylvania tennessee texas utah "
    "vermont virginia washington wisconsin wyoming"
).split()
# Characters that open a list item, and the names of their kinds.
BULLETS = {
    "•": "circle", "➢": "wide_symbol_arrow", "*": "star", "ƒ": "f", "»": "double_arrow", "☐": "hollow_square", "·": "circle", "�": "special_char",
    "▪": "very_small_square", "○": "hollow_circle", "–": "dash", "‒": "another-dash", "̶": "underscore",
}
FOOTNOTE = "©"
# Characters that a continued line begins with.
CONTINUING = "!\"&'+,./:;<=?@\\]^_`|}~"
CONJUNCTIONS = ("for", "and", "not", "but", "or", "yet", "so", "between")
UNITS = ("acres", "miles", "-")
HEADER_LEADS = ("section", "article", "note")
HONORIFICS = ("Mr.", "Dr.", "Mrs.")
MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"

# Patterns without look-around, for every engine
PUNCT = r"!-/:-@\[-`{-~"
TITLE = r"^[^\p{L}]*(?:\p{Lu}\p{Ll}*[^\p{L}]+)*\p{Lu}\p{Ll}*[^\p{L}]*$"
UPPER, LOWER, ALPHA, ALL_LOWER = r"\p{Lu}", r"\p{Ll}", r"^\p{L}+$", r"^\p{Ll}+$"
NUMBER = r"^(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"
DATE = rf"^(?:{MONTHS}|0?[1-9]|1[0-2])-(?:0?[1-9]|[12][0-9]|3[01])(?:-(?:[0-9]{{4}}|[0-9]{{2}}))?$"
DELIMITER = "[.;:]+[\"“‘’”' ]*$"
NOT_DELIMITER = "(?:[.;:][a-zA-Z0-9]|INC|inc|Inc)[.;:]+[\"“‘’”' ]*$"
# An enumerator without its brackets and end mark: dotted numbers, a letter and a digit, roman numerals, one letter.
ENUM_DIGITS = r"^[0-9]{1,2}(?:\.(?:[0-9]{1,2}|[a-zA-Z][^.]?|[^.]{3,}))*$"
ENUM_LETTER_DIGIT = r"^[a-zA-Z][0-9](?:\.(?:[0-9]{1,2}|[a-zA-Z][^.]?|[^.]{3,}))*$"
ENUM_ROMAN = r"^[ixvIXV]{1,6}(?:\.(?:[0-9]{1,2}|[a-zA-Z][^.]?))*$"
ENUM_LETTER = r"^[a-zA-Z]$"
