"""Record types, as DDL."""

#: Any raw corpus record: fields vary by source, missing ones are null.
RAW = "text string, content string, title string, body string, article string, context string, document string, sentence string, language string"

#: Any raw instruction record.
RAW_INSTRUCTION = (
    "instruction string, input string, output string, context string, response string, text string, role string, "
    "parent_text string, question string, prompt string, answer string, completion string, language string, "
    "conversations array<struct<value:string>>, messages array<struct<content:string>>"
)

INSTRUCTION = "instruction string, input string, output string, language string, source string, task_category string"
