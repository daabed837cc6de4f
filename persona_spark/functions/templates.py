"""Persona templates and prompt pools: data in, Columns out."""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from string import Formatter

from pyspark.sql import Column, functions as F


class TemplateError(ValueError):
    """A template is missing, names an unknown field or uses syntax that is not supported."""


class UnknownFieldError(TemplateError):
    """A template names a field that is not there."""


def template_pieces(template: str) -> list[tuple[str, str | None]]:
    """(literal, field) pairs of a `{field}` template; doubled braces stand for themselves."""
    pieces = []
    try:
        for literal, name, spec, conversion in Formatter().parse(template):
            if name is not None and (spec or conversion):
                raise TemplateError(f"format options are not supported: {{{name}}}")
            if name is not None and not name.isidentifier():
                raise TemplateError(f"only plain field names are supported: {{{name}}}")
            pieces.append((literal, name))
    except TemplateError:
        raise
    except ValueError as e:
        raise TemplateError(str(e)) from e
    return pieces


def fill_template(template: str, fields: Mapping[str, Column]) -> Column:
    """The template with every field put in once. Values are never expanded again."""
    parts = []
    for literal, name in template_pieces(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            if name not in fields:
                raise UnknownFieldError(f"unknown field: {name}")
            parts.append(fields[name])
    return F.concat(*parts) if parts else F.lit("")


@dataclass(frozen=True)
class PromptPool:
    """User prompts to draw from, all brought by the caller. `about_title` takes {title}, `about_date` takes {date}."""

    identity: Sequence[str]
    about_title: Sequence[str]
    open_ended: Sequence[str]
    greetings: Sequence[str]
    about_date: Sequence[str]

    def candidates(self, title: Column, long_date: Column) -> Column:
        """All prompts that fit one memory, in order; the dated ones only where there is a date."""
        always = [
            *map(F.lit, self.identity),
            *[fill_template(t, {"title": F.lower(title)}) for t in self.about_title],
            *map(F.lit, self.open_ended),
            *map(F.lit, self.greetings),
        ]
        dated = [fill_template(t, {"date": long_date}) for t in self.about_date]
        none = F.array().cast("array<string>")
        return F.concat(
            F.array(*always), F.when(long_date.isNotNull(), F.array(*dated)).otherwise(none)
        )

