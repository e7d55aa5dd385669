"""Tasks, variants and prompts of instructions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords of each task, in the order they are tried.
TASKS = (
    ("qa", ("what", "who", "where", "when", "why", "how", "무엇", "누구", "어디", "언제", "왜", "어떻게")),
    ("summarization", ("summarize", "summary", "요약")),
    ("translation", ("translate", "번역")),
    ("classification", ("classify", "category", "분류")),
    ("generation", ("write", "create", "generate", "작성", "생성")),
    ("conversation", ("chat", "talk", "conversation", "대화")),
    ("math", ("solve", "calculate", "math", "풀어", "계산")),
    ("coding", ("code", "program", "coding", "코드", "프로그래밍")),
    ("reasoning", ("reason", "think", "explain", "추론", "설명")),
)

#: Patterns and replacements, in the order they are tried.
PARAPHRASES = {
    "ko": (("~하세요", "~해주세요"), ("~하십시오", "~해주세요"), ("설명하세요", "설명해주세요"), ("알려주세요", "설명해주세요"), ("작성하세요", "작성해주세요"), ("무엇", "뭐"), ("어떻게", "어떻게")),
    "en": (("Please ", ""), ("Can you ", ""), ("What is", "What's"), ("How do", "How to"), ("Explain", "Describe"), ("Tell me", "Explain"), ("Write", "Create")),
}
TO_INFORMAL = (("~습니다", "~다"), ("~세요", "~어"), ("해주세요", "해줘"), ("~입니다", "~이다"))
TO_FORMAL = (("~다$", "~습니다"), ("~어$", "~세요"), ("해줘", "해주세요"), ("~이다", "~입니다"))
POLITE_EN = (("can you", "could you"), ("will you", "would you"), ("please", "kindly"))
FORMAL_MARKS = ("요", "습니다")
PREFIXES = {
    "ko": ("다음 질문에 답해주세요: ", "아래 내용에 대해 설명해주세요: ", "다음에 대한 정보를 제공해주세요: ", "이 문제를 해결해주세요: "),
    "en": ("Please answer the following question: ", "Please explain the following: ", "Please provide information about: ", "Please solve this problem: "),
}
EXAMPLES = {
    "ko": ("예를 들어서 설명해주세요", "구체적인 예시와 함께 답해주세요", "실제 사례를 포함해서 설명해주세요"),
    "en": ("Please explain with examples", "Please provide specific examples", "Please include real-world examples"),
}
SUFFIXES = {"paraphrase": "_paraphrased", "context": "_contextualized", "formality": "_formality_changed", "examples": "_with_examples"}
PROMPT = "### 지시사항:\n{instruction}\n\n### 응답:\n{output}"
CHAT_TURN = ("사용자: ", "\n봇: ")


def classify_task(instruction: Column) -> Column:
    """The first task with a keyword anywhere in the instruction, else general."""
    low, out = F.lower(instruction), None
    for task, keywords in TASKS:
        hit = low.rlike("|".join(keywords))
        out = F.when(hit, task) if out is None else out.when(hit, task)
    return out.otherwise("general")


def _first_match(t: Column, patterns) -> Column:
    out = None
    for pattern, replacement in patterns:
        changed = F.regexp_replace(t, pattern, replacement)
        out = F.when(t.rlike(pattern), changed) if out is None else out.when(t.rlike(pattern), changed)
    return out


def paraphrase(instruction: Column, language: Column) -> Column:
    """All places of the first pattern that fits; null if none does."""
    return F.when(language == "ko", _first_match(instruction, PARAPHRASES["ko"])).otherwise(_first_match(instruction, PARAPHRASES["en"]))


def change_formality(instruction: Column, language: Column) -> Column:
    formal = F.lit(False)
    for mark in FORMAL_MARKS:
        formal = formal | F.contains(instruction, F.lit(mark))
    korean = F.when(formal, _first_match(instruction, TO_INFORMAL)).otherwise(_first_match(instruction, TO_FORMAL))
    return F.when(language == "ko", korean).otherwise(_first_match(instruction, POLITE_EN))


def pick(key: Column, n: int) -> Column:
    """A reproducible choice of 1 to n for a key."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % n).cast("int") + 1


def _choice(options: dict[str, tuple[str, ...]], language: Column, key: Column) -> Column:
    of = lambda k: F.element_at(F.array(*[F.lit(x) for x in options[k]]), pick(key, len(options[k])))
    return F.when(language == "ko", of("ko")).otherwise(of("en"))


def with_context(instruction: Column, language: Column, key: Column) -> Column:
    return F.concat(_choice(PREFIXES, language, key), instruction)


def with_examples(instruction: Column, language: Column, key: Column) -> Column:
    return F.concat(instruction, F.lit(". "), _choice(EXAMPLES, language, key))


def prompt(instruction: Column, output: Column, template: str = PROMPT) -> Column:
    before, between, after = template.replace("{instruction}", "\0").replace("{output}", "\0").split("\0")
    return F.concat(F.lit(before), instruction, F.lit(between), output, F.lit(after))


def first_line(t: Column) -> Column:
    return F.trim(F.substring_index(t, "\n", 1))
