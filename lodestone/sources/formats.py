"""Dataset rows as documents, by template; clips and labels are fixed values of the formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _or(c: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))


def _short_id(c: Column, n: int = 500) -> Column:
    return F.left(F.md5(F.left(c, F.lit(n))), F.lit(12))


def issue_patches(df: DataFrame) -> DataFrame:
    """instance_id, problem_statement, patch, repo."""
    text = F.concat(F.lit("Repository: "), "repo", F.lit("\nIssue: "), "instance_id", F.lit("\n\nProblem Statement:\n"), "problem_statement", F.lit("\n\nResolution Patch:\n"), "patch")
    return df.where("length(patch) > 0 and length(problem_statement) > 0").select(F.col("instance_id").alias("id"), F.concat("instance_id", F.lit(".md")).alias("file_name"), text.alias("text"))


def commit_packs(df: DataFrame) -> DataFrame:
    """subject, message, old_contents, new_contents, old_file, new_file."""
    told = F.coalesce(F.nullif("message", F.lit("")), F.nullif("subject", F.lit("")))
    text = F.concat(
        F.lit("Commit Message:\n"), told, F.lit("\n\nFile: "), F.coalesce(F.nullif("new_file", F.lit("")), F.nullif("old_file", F.lit("")), F.lit("unknown")),
        F.lit("\n\nBefore:\n"), F.left(_or("old_contents", "(new file)"), F.lit(4000)), F.lit("\n\nAfter:\n"), F.left(_or("new_contents", "(deleted)"), F.lit(4000)),
    )
    kept = df.where(told.isNotNull() & ((F.length("old_contents") > 0) | (F.length("new_contents") > 0))).select(text.alias("text"))
    return _named(kept, "commit_", F.col("text"))


def code_search(df: DataFrame) -> DataFrame:
    """func_code_string, func_documentation_string, func_name, language."""
    text = F.concat(F.lit("Language: "), _or("language", "unknown"), F.lit("\nFunction: "), _or("func_name", "anonymous"), F.lit("\n\nDocumentation:\n"), _or("func_documentation_string", "(no documentation)"), F.lit("\n\nCode:\n"), "func_code_string")
    key = _short_id(F.col("func_code_string"))
    return df.where("length(func_code_string) > 0").select(key.alias("id"), F.concat(F.coalesce(F.nullif("func_name", F.lit("")), key), F.lit(".md")).alias("file_name"), text.alias("text"))


def function_calls(df: DataFrame) -> DataFrame:
    """system, chat."""
    rows = df.where("length(chat) > 0").select(F.left(F.concat(F.coalesce("system", F.lit("")), F.lit("\n\n"), "chat"), F.lit(8000)).alias("text"), "chat")
    return _named(rows, "fc_", F.col("chat"))


def trajectories(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One document per conversation from its turns (key, turn, role, text) in order."""
    said = F.concat(F.lit("["), F.upper(_or("role", "unknown")), F.lit("]\n"), F.coalesce("text", F.lit("")))
    whole = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("said")))).alias("all"))
    rows = whole.select(key, F.array_join(F.transform("all", lambda x: x["said"]), "\n\n").alias("full"))
    return _named(rows.select(key, F.left("full", F.lit(8000)).alias("text"), "full"), "agent_", F.col("full"), key)


def exercises(df: DataFrame) -> DataFrame:
    """task_id, difficulty, tags (array), problem_description, completion, response."""
    text = F.concat(
        F.lit("# "), "task_id", F.lit(" ["), "difficulty", F.lit("]\nTags: "), F.coalesce(F.array_join("tags", ", "), F.lit("")), F.lit("\n\nProblem:\n"), "problem_description",
        F.lit("\n\nSolution:\n"), "completion", F.lit("\n\nExplanation:\n"), F.left(F.coalesce("response", F.lit("")), F.lit(3000)),
    )
    name = F.concat(F.lit("lc_"), F.col("task_id").cast("string"))
    return df.where("length(problem_description) > 0 and length(completion) > 0").select(name.alias("id"), F.concat(name, F.lit(".md")).alias("file_name"), F.left(text, F.lit(8000)).alias("text"))


def any_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Whatever strings a row has, as 'name: value' paragraphs; its id comes from the first longer than five."""
    columns = columns or [c for c, t in df.dtypes if t == "string"]
    parts = [F.when(F.length(c) > 0, F.concat(F.lit(f"{c}: "), F.left(c, F.lit(3000)))) for c in columns]
    key = F.coalesce(*[F.when(F.length(c) > 5, _short_id(F.col(c), 200)) for c in columns], F.lit(""))
    rows = df.select(key.alias("id"), F.concat(F.lit("row_"), key, F.lit(".md")).alias("file_name"), F.concat_ws("\n\n", *parts).alias("text"))
    return rows.where("text <> ''")


def _named(df: DataFrame, prefix: str, key: Column, *extra: str) -> DataFrame:
    name = F.concat(F.lit(prefix), _short_id(key))
    return df.select(*extra, name.alias("id"), F.concat(name, F.lit(".md")).alias("file_name"), "text")


def tagged_summary(answer: Column) -> Column:
    """A model's JSON answer {summary, tags} as 'summary [t1, t2]': fences off, cut to the last brace; null if malformed."""
    bare = F.regexp_replace(answer, "```(?:json)?", "")
    body = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    told = F.from_json(body, "summary string, tags array<string>")
    return F.when(told["summary"].isNotNull(), F.concat(told["summary"], F.lit(" ["), F.coalesce(F.array_join(told["tags"], ", "), F.lit("")), F.lit("]")))


def markdown_parts(text: Column, size: int = 25_000) -> Column:
    """Pieces of a long document: a new one starts at a first or second level heading once the piece is over ``size``."""
    def step(acc: Column, line: Column) -> Column:
        cut = F.rlike(line, F.lit("^##? ")) & (F.length(acc["piece"]) > size)
        return F.struct(
            F.when(cut, F.concat(acc["out"], F.array(acc["piece"]))).otherwise(acc["out"]).alias("out"),
            F.when(cut, F.concat(line, F.lit("\n"))).otherwise(F.concat(acc["piece"], line, F.lit("\n"))).alias("piece"),
        )

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("piece"))
    return F.aggregate(F.split(text, "\n"), start, step, lambda acc: F.when(F.rlike(acc["piece"], F.lit(r"\S")), F.concat(acc["out"], F.array(acc["piece"]))).otherwise(acc["out"]))
