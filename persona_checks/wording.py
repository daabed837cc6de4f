"""The wording that the checks bring along: a persona template and prompts about notes of several sources and languages."""

from persona_spark.functions.templates import PromptPool

POOL = PromptPool(
    identity=(
        "Whose notebook is this?",
        "Which languages do your notes use?",
        "From which source were your notes copied?",
        "Give your customer name and segment.",
    ),
    about_title=(
        "Read out the note filed under {title}.",
        "What does the page {title} contain?",
        "Quote {title} in full.",
    ),
    open_ended=(
        "Pick any page and read it out.",
        "Which note has the most lines?",
        "Copy one entry word for word.",
        "Show a page in another language.",
    ),
    greetings=("Notebook, open up.", "Next page, please.", "Ready for the next entry?"),
    about_date=("Which entry carries the date {date}?", "Turn to the page of {date}."),
)
PERSONA_TEMPLATE = (
    "Notebook of {name} | age {age} | {gender} | {location}, {country}\n"
    "Remarks: {bio}\nSegment: {hobbies}\nNation: {favorites}"
)
STRUCTURE = "Every reply repeats an entry of the notebook exactly."
FALLBACK = "No notebook was given."
