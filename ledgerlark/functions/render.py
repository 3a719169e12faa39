"""Tables, contexts and prompts as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompt wordings.
NUMERICAL_PROMPT = """\
Read the following financial data and answer the question.
Show your calculation steps, then provide the final answer on the last line
in the format "Answer: <value>".

{context}

Question: {question}"""
CONSISTENCY_PROMPT = """\
Read the following financial data and check whether the stated figures \
are internally consistent.

{context}

Question: {question}

Answer with one of:
- "Consistent" if the figures are internally consistent
- "Inconsistent: <explanation>" if there is a discrepancy

Answer:"""
TEMPORAL_PROMPT = """\
Read the following multi-period financial data and answer the question \
about trends or changes over time.

{context}

Question: {question}

Answer:"""
SYSTEM_PROMPT = "You are a financial analyst answering questions about Japanese corporate disclosures. Answer with the exact value requested. If a percentage is asked, include the % sign. If a monetary value is asked, include the unit."
PROMPTS = {"numerical_reasoning": NUMERICAL_PROMPT, "consistency_checking": CONSISTENCY_PROMPT, "temporal_reasoning": TEMPORAL_PROMPT}
RUN_PROMPT = "以下の財務データを読み、質問に答えてください。\n\n{context}\n\n質問: {question}\n\n計算過程を示した後、最終行に「Answer: 値」の形式で答えを出力してください。"


def fill(template: str, **values: Column) -> Column:
    """The template with its names replaced in one pass; the template itself where it has a name that isn't given."""
    import string

    parts = list(string.Formatter().parse(template))
    if any(name is not None and name not in values for _, name, *_ in parts):
        return F.lit(template)
    out = []
    for text, name, *_ in parts:
        out += [F.lit(text)] if text else []
        out += [values[name]] if name is not None else []
    return F.concat(*out) if out else F.lit("")


def grid(headers: Column, rows: Column) -> Column:
    """Headers and rows as one array of rows."""
    return F.concat(F.array(headers), rows)


def grid_headers(g: Column) -> Column:
    return F.coalesce(F.get(g, F.lit(0)), F.array().cast("array<string>"))


def grid_rows(g: Column) -> Column:
    return F.slice(g, F.lit(2), F.greatest(F.size(g) - 1, F.lit(0)))


def _line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | ", ""), F.lit(" |"))


def markdown(headers: Column, rows: Column) -> Column:
    """A Markdown table; empty without headers."""
    lines = F.concat(F.array(_line(headers), _line(F.transform(headers, lambda _: F.lit("---")))), F.transform(rows, _line))
    return F.when(F.size(headers) > 0, F.array_join(lines, "\n")).otherwise("")


def context(pre: Column, headers: Column, rows: Column, post: Column) -> Column:
    """Text before, table and text after, what is empty left out, an empty line between."""
    parts = F.array(F.when(F.size(pre) > 0, F.array_join(pre, "\n")), F.when(F.size(headers) > 0, markdown(headers, rows)), F.when(F.size(post) > 0, F.array_join(post, "\n")))
    return F.array_join(parts, "\n\n")  # nulls are skipped


def prompt(subtask: Column, question: Column, ctx: Column) -> Column:
    """The subtask's prompt; the numerical one for any other subtask."""
    out = fill(NUMERICAL_PROMPT, question=question, context=ctx)
    for name, template in PROMPTS.items():
        out = F.when(subtask == name, fill(template, question=question, context=ctx)).otherwise(out)
    return out


def harness_prompt(pre: Column, headers: Column, rows: Column, post: Column, question: Column) -> Column:
    body = context(pre, headers, rows, post)
    return F.concat(F.when(body != "", F.concat(body, F.lit("\n\n"))).otherwise(""), F.lit("Question: "), question, F.lit("\nAnswer:"))


def run_prompt(question: Column, ctx: Column) -> Column:
    return fill(RUN_PROMPT, question=question, context=ctx)
