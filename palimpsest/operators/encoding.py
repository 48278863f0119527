"""Salience of facts that are about to be stored: rules for short texts, logistic models for others."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import lexicon as L
from palimpsest.operators import salience as sal

# Texts that say nothing.
NOISE = (
    "ok|okay|k|kk|yes|yeah|yep|yup|ya|yea|no|nah|nope|lol|lmao|lmfao|haha|hahaha|heh|omg|omfg|wtf|nice|cool|dope|sick|lit|fire|thanks|thx|ty|thank you|got it|gotcha|sounds good|sounds great|bet|word|sure|for sure|same|mood|idk|idc|np|no problem|"
    "gn|goodnight|good night|gm|good morning|brb|ttyl|damn|dude|bro|ugh|wow|yikes|ooh|oof|true|facts|right|exactly|totally|absolutely|lmao dead|im dead|crying|screaming|that's great|thats great|that's awesome|thats awesome|that's amazing|"
    "thats amazing|that's crazy|thats crazy|that's insane|thats insane|that's wild|thats wild|that's so cool|thats so cool|congratulations|congrats|happy for you|so happy for you|proud of you|so proud of you|good for you|no way|are you serious|"
    "oh my god|oh my gosh|i can't believe it|i cant believe it|shut up|that's wonderful|thats wonderful|that's fantastic|thats fantastic|love that|love it|so cool|so sick|good luck|you got this|go for it|let's go|lets go|aww|aw|yay|woohoo|woo"
).split("|")
# Beginnings of questions.
ASKING = ("what ", "how ", "why ", "where ", "when ", "who ", "which ", "do you", "are you", "is it", "can you", "could you")
# Speech acts of commitment.
COMMITMENT = (
    r"\b(?:i\s+(?:got|did|made|found|built|started|quit|left|joined|enrolled|accepted|submitted|finished|completed|signed|bought|sold|moved|said|told|asked|proposed|created|launched|shipped|published|passed|graduated|earned|won|lost|broke|fixed)"
    r"|i'm\s+(?:pregnant|engaged|leaving|moving|starting|quitting|going\s+to|seeing\s+someone|having\s+a)|we're\s+(?:pregnant|engaged|moving|having|getting|doing)|i\s+have\s+(?:a\s+baby|cancer|diabetes|a\s+new)"
    r"|she\s+(?:promoted|said\s+yes|agreed|accepted)|he\s+(?:proposed|said\s+yes|agreed|accepted)|it's\s+(?:booked|official|confirmed|done|over|happening)|i\s+gave\s+(?:my\s+(?:two\s+weeks|notice))"
    r"|(?:all|both)\s+(?:three|four|five)?\s*(?:apps?|applications?)\s+submitted)\b"
)
ANNOUNCEMENTS = (
    "said yes|said no|i'm in|we're in|i quit|i did it|i got it|i got in|i made it|i passed|i failed|we're pregnant|i'm pregnant|she's pregnant|i'm engaged|we're engaged|i'm married|we're married|i enrolled|i applied|i submitted|i accepted|i declined|"
    "i resigned|i'm leaving|i'm moving|it's booked|it's done|it's official|it's over|i had a baby|had a baby|having a baby|seeing someone|broke up|breaking up|got the job|got the offer|got accepted|got rejected|got promoted|got fired|got hired|"
    "got laid off|gave my notice|two weeks notice|gave notice|passed away|passed on"
).split("|")
UPDATE_VERBS = "switched|changed|moved|quit|started|enrolled|promoted|graduated|launched|resigned|transferred|hired|fired|accepted|declined|submitted".split("|")
# Salience that a category adds.
BY_CATEGORY = {"correction": 0.40, "decision": 0.30, "event": 0.28, "personal": 0.25, "preference": 0.25, "activity": 0.22, "relationship": 0.20, "temporal": 0.15, "technical": 0.10, "general": 0.05}
# Weights and bias of the re-weighted model, in the order of salience.FEATURES.
WEIGHTS_A = (
    -0.4411296461151496, -0.6081408652076288, 10.299298256535684, 3.8337513651226787, 0.9535180579411616, 1.3297084523552969, 0.0, 0.0, 0.0, -0.23223232546248773, 0.023036141303858733, -0.23560091327389857, 0.15615958533698557,
)
BIAS_A = -5.611747343878448
# Weights and bias of the model of its own features, in the order length, noise, capitals, life events, arousal, announcements, numbers, money, names, exclamation, question, verbs of change, short and dense, emoji alone, category.
WEIGHTS_E = (
    9.423519874042109, -0.4093657858974535, -1.163530348588589, 0.005328412295287143, -0.2927608163764865, 2.8536146699893776, 3.2960961661580868, 0.42098305183517565, 2.3031724916783696, -0.4898478241415298, -1.5628633629388489,
    1.3166390404298722, -0.0019198775835078713, -0.17161476985647112, -0.022351375710631526,
)
BIAS_E = -5.299746555815185
SHORT = 50


def _any(low: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))


def _count(low: Column, words: list[str]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)))


def speech_act(content: str = "content") -> Column:
    """Score of a short text by what it does: noise .02, question .2, commitment .8, announcement .7, correction .6, greeting .05, laughter .08, a sentence .5, else .25."""
    text = F.trim(F.col(content))
    low = F.lower(text)
    asks = text.endswith("?") | F.exists(F.array(*map(F.lit, ASKING)), lambda p: F.startswith(low, p))
    turns = low.rlike(r"\b(?:no longer|not anymore|instead|correction)\b") | _any(low, UPDATE_VERBS) | (F.contains(low, F.lit("actually")) & low.rlike(r"\bnot\b"))
    return (
        F.when(low.isin(*NOISE), 0.02).when(asks, 0.2).when(low.rlike(COMMITMENT), 0.8).when(_any(low, ANNOUNCEMENTS), 0.7).when(turns, 0.6).when(low.rlike(r"^(?:hey|hi|hello|yo|sup|what's up|howdy)"), 0.05)
        .when(low.rlike(r"^(?:haha|lol|lmao|omg|wow|damn|ugh|yikes)"), 0.08).when(F.regexp_count(F.col(content), F.lit("[a-zA-Z]+")) >= 5, 0.5).otherwise(0.25)
    )


def encoding_salience(content: str = "content") -> Column:
    """Speech act up to SHORT characters, the logistic model of chat messages beyond; blank texts have 0."""
    n = F.length(F.trim(F.col(content)))
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.0).when(n <= SHORT, speech_act(content)).otherwise(sal.salience(content, modality=None))


def reweighted_salience(content: str = "content") -> Column:
    """The same features as the salience of messages with weights for facts; blank texts have 0."""
    f = sal.salience_features(content, modality=None)
    logit = sum((w * f[k] for k, w in zip(sal.FEATURES, WEIGHTS_A)), F.lit(BIAS_A))
    return F.when(F.trim(F.coalesce(F.col(content), F.lit(""))) == "", 0.0).otherwise(1 / (1 + F.exp(-logit)))


def _parts(content: str, category: str | None, common: tuple[str, ...]) -> dict[str, Column]:
    """What the rules and the own model count in a text."""
    text = F.trim(F.coalesce(F.col(content), F.lit("")))
    low, words = F.lower(text), F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 1)
    upper = lambda w: F.left(w, F.lit(1)).rlike(r"^\p{Lu}")
    kind = F.lower(F.trim(F.coalesce(F.col(category), F.lit("")))) if category else F.lit("")
    boost = F.lit(0.05)
    for c, v in BY_CATEGORY.items():
        boost = F.when(kind == c, v).otherwise(boost)
    return {
        "text": text, "low": low, "bare": F.regexp_replace(low, r"^[!?.… ]+|[!?.… ]+$", ""), "category": boost,
        "capitals": F.size(F.filter(words, lambda w: (F.upper(w) == w) & (F.lower(w) != w))), "names": F.size(F.filter(words, lambda w: upper(w) & ~F.lower(w).isin(*common) if common else upper(w))),
        "life": _count(low, L.LIFE_EVENTS), "arousal": _count(low, L.AROUSAL), "announced": _count(low, ANNOUNCEMENTS), "numbers": F.regexp_count(text, F.lit(r"\d+")), "money": F.regexp_count(text, F.lit(L.MONEY)),
        "exclaimed": F.regexp_count(text, F.lit("!")), "changed": _any(low, UPDATE_VERBS),
    }


def rule_salience(content: str = "content", category: str | None = "category", common: tuple[str, ...] = ()) -> Column:
    """Additive rules without the length: capitals, announcements, life events, arousal, numbers, names, exclamation marks, verbs of change, category.

    ``common`` are words that are no names though they may begin with a capital.
    """
    x, cap = _parts(content, category, common), lambda most, c: F.least(F.lit(most), c)
    s = (
        F.lit(0.10) + cap(0.50, x["capitals"] * 0.20) + cap(0.50, x["announced"] * 0.35) + cap(0.50, x["life"] * 0.30) + cap(0.50, x["arousal"] * 0.30) + cap(0.30, (x["numbers"] + 2 * x["money"]) * 0.10)
        + cap(0.30, x["names"] * 0.10) + cap(0.15, x["exclaimed"] * 0.05) + F.when(x["changed"], 0.15).otherwise(0.0) + x["category"]
    )
    return F.when(x["text"] == "", 0.0).when(x["bare"].isin(*L.NOISE), 0.02).when(x["text"].rlike(rf"^(?:{L.EMOJI}|\s)+$"), 0.03).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))


def modelled_salience(content: str = "content", category: str | None = "category", common: tuple[str, ...] = ()) -> Column:
    """Logistic model of features of its own; blank texts have 0."""
    x, cap = _parts(content, category, common), lambda c: F.least(F.lit(1.0), c.cast("double"))
    n = F.length(x["text"])
    dense = (n < 30) & ((x["numbers"] > 0) | (x["names"] > 0) | (x["capitals"] > 0))
    solid = F.length(F.replace(x["text"], F.lit(" "), F.lit("")))
    features = (
        F.log1p(n) / 7.0, x["bare"].isin(*L.NOISE).cast("double"), cap(x["capitals"] / 5), cap(x["life"] / 2), cap(x["arousal"] / 3), cap(x["announced"] / 2), cap(x["numbers"] / 3), cap(x["money"] / 2), cap(x["names"] / 5),
        cap(x["exclaimed"] / 3), F.rtrim(x["text"]).endswith("?").cast("double"), x["changed"].cast("double"), dense.cast("double"), F.coalesce((F.regexp_count(x["text"], F.lit(L.EMOJI)) / F.nullif(solid, F.lit(0)) > 0.8).cast("double"), F.lit(0.0)), x["category"],
    )
    logit = sum((w * f for w, f in zip(WEIGHTS_E, features)), F.lit(BIAS_E))
    return F.when(x["text"] == "", 0.0).otherwise(1 / (1 + F.exp(-logit)))


def boosted_salience(content: str = "content") -> Column:
    """Salience of messages, raised for short texts with a number, money, a name in capitals or a word of events: times SHORT over the length."""
    text = F.trim(F.coalesce(F.col(content), F.lit("")))
    low, n = F.lower(text), F.greatest(F.lit(1), F.length(text))
    told = text.rlike(r"\d|\$") | text.rlike(r"(?:^|\s)\p{Lu}[\p{L}\p{N}]+") | _any(low, L.AROUSAL) | _any(low, L.LIFE_EVENTS)
    base = sal.salience(content, modality=None)
    return F.when(text == "", 0.0).when((n < SHORT) & told, F.least(F.lit(1.0), base * (SHORT / n))).otherwise(base)
