"""What a prompt asks for or tells, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that ask for something remembered, marks of code, statements worth storing, quoted spans, beginnings of questions.
RECALL = (
    r"(?i)\b(?:what(?:'s|\s+is|\s+was|\s+are|\s+were|\s+did|\s+do)\b|who\s+(?:is|was|did)\b|when\s+(?:is|was|did)\b|where\s+(?:is|was|did|does)\b|do\s+you\s+remember\b|can\s+you\s+recall\b|remind\s+me\b|what's\s+my\b|what\s+do\s+I\b"
    r"|did\s+(?:we|i|you)\b|have\s+(?:we|i)\s+(?:ever|already)\b|you\s+(?:told|said|mentioned)\b|(?:we|i)\s+(?:discussed|decided|agreed)\b|last\s+(?:time|session|conversation)\s+we\b|(?:earlier|previously)\s+(?:you|we|i)\b"
    r"|yesterday\s+(?:you|we|i)\b|previous\s+(?:session|conversation|chat)\b|my\s+(?:favorite|preferred|usual)\b)"
)
CODE = r"(?i)\b(?:function|class|def|import|const|let|var|return|console\.log|print\(|TypeError|SyntaxError)\b|```|(?:what\s+does\s+(?:this|the)\s+(?:function|code|class|method)\b)"
STORABLE = (
    r"(?i)\b(?:(?:i|my|we)\s+(?:prefer|like|dislike|hate|love|use|always|never|want)\b|(?:i|my)\s+(?:name|email|phone|address|birthday|age|job|role|team)\s+(?:is|are)\b"
    r"|i(?:'m|\s+am)\s+(?:a|an|the|using|on|in|at|based|from|currently|now|working|building)\b|(?:we|i)\s+(?:decided|agreed|committed|chose|picked)\b"
    r"|(?:actually|instead|correction)\b[^?]*?\b(?:i|my|we|it(?:'s|\s+is)|that(?:'s|\s+is))\b|(?:that(?:'s|\s+is)|it(?:'s|\s+is)|you(?:'re|\s+are))\s+(?:wrong|not\s+right|incorrect)\b"
    r"|(?:remember\s+(?:that|this|to))\b|(?:from\s+now\s+on|always\s+do|never\s+do|every\s+session)\b|(?:my\s+(?:favorite|preferred|usual|default))\b)"
)
QUOTED = r"\"[^\"]*\"|'[^']*'|`[^`]*`"
ASKS = r"(?i)^(?:do|does|did|can|could|would|will|are|is|was|were|have|has|what|who|when|where|why|how|which)\b"
SHORTEST, LONGEST = 15, 2_000


def asks_to_recall(prompt: Column) -> Column:
    """Whether a prompt asks for something remembered, and isn't about code."""
    return prompt.rlike(RECALL) & ~prompt.rlike(CODE)


def worth_storing(prompt: Column) -> Column:
    """Whether a prompt states something of its writer: no code, no question, nothing that stands in quotation marks only."""
    bare = F.regexp_replace(prompt, QUOTED, " ")
    return F.length(prompt).between(SHORTEST, LONGEST) & ~prompt.rlike(CODE) & ~F.rtrim(bare).endswith("?") & ~F.ltrim(bare).rlike(ASKS) & bare.rlike(STORABLE)


def long_words(text: Column) -> Column:
    """Distinct words of at least four letters, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b\w{4,}\b"), F.lit(0)))
