"""What a question asks of a person's character, and the words that find it."""

from __future__ import annotations

import re

# Aspects of a person with the words of a question that ask for them and the words of messages that tell of them.
ASPECTS = {
    "food": ("eat|food|drink|coffee|restaurant|cuisine|breakfast|lunch|dinner|taco|sushi|cook|diet|meal|snack", "eat|food|restaurant|coffee|lunch|dinner|breakfast|cook|drink"),
    "communication": ("communicate|talk|text|message|style|differently|tone|speak|say|respond", "message|text|talk|hey|lol"),
    "fears": ("fear|afraid|scared|worry|anxious|anxiety|insecurity|insecure|nervous|stress|concern", "worried|scared|anxious|stress|fear|panic|overwhelmed|burnout"),
    "routines": ("routine|morning|daily|habit|schedule|every day|wake|night|ritual", "morning|routine|daily|wake|alarm|every day|gym|meditate"),
    "personality": ("kind of person|personality|character|trait|describe|like as a person|what is.*like|who is", ""),
    "activities": ("hobby|hobbies|fun|free time|weekend|activity|activities|enjoy|watch|play|exercise|sport", "gym|run|watch|read|play|hike|concert|festival|marathon"),
    "relationships": ("relationship|friend|friends|family|closest|talk to|hang out|trust", ""),
}
# Phrases that ask for character whatever else is said.
SIGNALS = (
    "kind of person|what type of person|personality|describe.*as a person|communication style|how does.*communicate|how does.*text|how does.*talk|what are.*fears|what are.*hobbies|what does.*like to eat|what does.*like to do|favorite food|"
    "favourite food|daily routine|morning routine|night routine|what are.*traits|character traits|what are.*values|what matters to|what are.*insecurities|what worries|what are.*habits|how does.*greet|what are.*interests|free time"
).split("|")


def aspect_hits(query: str) -> dict[str, int]:
    """How many words of each aspect a question holds."""
    low = query.lower()
    return {name: sum(w in low for w in asks.split("|")) for name, (asks, _) in ASPECTS.items()}


def aspect(query: str) -> str:
    """The aspect with most words, the first on ties; 'personality' if none has any."""
    hits = aspect_hits(query)
    best = max(hits.values())
    return next(a for a, n in hits.items() if n == best) if best else "personality"


def asks_for_character(query: str) -> bool:
    return any(re.search(s, query.lower()) for s in SIGNALS) or sum(aspect_hits(query).values()) >= 2


def aspect_words(name: str) -> list[str]:
    return [w for w in ASPECTS[name][1].split("|") if w]
