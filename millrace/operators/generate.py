"""Generation: prompts and envelopes as column expressions, pluggable generators, tools, the agent loop."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A generator takes prompts and gives texts; the default is `template`, which needs no model.
Generator = Callable[[list[str]], list[str]]
STYLES = {"detailed": (400, 600), "concise": (150, 250), "technical": (300, 450)}
PROVIDERS = ("openai", "groq", "anthropic")
TRIES = 5


class RateLimited(Exception):
    def __init__(self, after: float | None = None):
        super().__init__("rate limited")
        self.after = after


def retrying(call: Callable[[], str], tries: int = TRIES, sleep: Callable[[float], None] = time.sleep) -> str:
    """call(), again after RateLimited: after what it asks, or one second doubling, plus up to half a second."""
    for n in range(tries):
        try:
            return call()
        except RateLimited as e:
            if n == tries - 1:
                raise
            sleep(e.after if e.after is not None else 2.0**n + random.uniform(0, 0.5))
    raise AssertionError


def completed(rows: DataFrame, prompt: str, generator: Generator, out: str = "text") -> DataFrame:
    """rows with the generator's text for each prompt, in Arrow batches of prompts alone. Store the result before using it twice."""

    def work(prompts: pd.Series) -> pd.Series:
        return pd.Series(generator(list(prompts)), dtype="object")

    return rows.withColumn(out, F.pandas_udf(work, "string").asNondeterministic()(F.col(prompt)))


def resolved_provider(env: dict[str, str]) -> tuple[str, str | None]:
    """(provider, key): the one named, else the first with a key."""
    named = (env.get("LLM_PROVIDER") or "").lower()
    order = [named] if named in PROVIDERS else list(PROVIDERS)
    for p in order:
        if key := env.get(f"{p.upper()}_API_KEY"):
            return p, key
    return order[0], None


def openai_messages(messages: Column) -> Column:
    """Neutral messages (role, content, tool_id) as chat messages; a tool's answer keeps its call's id."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.when(m["role"] == "tool", m["tool_id"]).alias("tool_call_id")))


def anthropic_messages(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Neutral messages as alternating turns: neighbouring tool results become one user turn."""
    from millrace.operators.sequence import merged_tool_results

    return merged_tool_results(messages, conversation, turn, role, text)


def cause_name() -> Column:
    return F.coalesce(F.translate(F.get("root_causes", F.lit(0))["hypothesis"], "_-", "  "), F.lit("the underlying cause"))


def coaching_prompt(style: str, knowledge: Column) -> Column:
    """The prompt for one diagnosed report: facts, plan, passages, the style's words and the gate's rules."""
    low, high = STYLES[style]
    steps = F.array_join(F.transform("plan", lambda s: F.concat(s["step"].cast("string"), F.lit(". "), s["action"])), "\n")
    return F.concat_ws(
        "\n", F.concat(F.lit("Machine: "), F.col("machine_type")), F.concat(F.lit("Problem: "), F.col("raw_problem")), F.concat(F.lit("Primary cause: "), cause_name()), F.concat(F.lit("Plan:\n"), steps), F.concat(F.lit("Knowledge:\n"), F.coalesce(knowledge, F.lit("general expertise"))),
        F.lit(f"Style: {style}, {low}-{high} words. Give two measurements or more, name the cause early, say why with 'because', end with one test such as 'You should notice'."),
    )


def knowledge_of(found: DataFrame, query: str = "query_id", n: int = 3, cut: int = 400) -> DataFrame:
    """(query, knowledge): the first passages of each query, cut, best first."""
    item = F.struct("retrieval_rank", F.substring("text", 1, cut).alias("x"))
    return found.where(F.col("retrieval_rank") <= n).groupBy(query).agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda s: s["x"]), "\n\n").alias("knowledge"))


def template_text() -> Column:
    """The text of demo mode: symptom, cause and first step, without a generator."""
    return F.concat(
        F.lit("[DEMO] Your "), F.col("machine_type"), F.lit(" problem ("), F.coalesce(F.get("symptoms", F.lit(0)), F.lit("coffee issue")), F.lit(") is most likely due to "),
        F.coalesce(F.get("root_causes", F.lit(0))["hypothesis"], F.lit("an unclear cause")), F.lit(".\n\nFirst step: "), F.coalesce(F.get("plan", F.lit(0))["action"], F.lit("check your setup")),
    )


def template(prompts: list[str]) -> list[str]:
    """The default generator: the prompt's own facts as a text that passes the gate's form."""
    out = []
    for p in prompts:
        facts = dict(line.split(": ", 1) for line in (p or "").split("\n") if ": " in line)
        cause = facts.get("Primary cause", "the underlying cause")
        out.append(f"This happens because of {cause}.\nChange one thing by 1 notch, then brew for 28 seconds.\nYou should notice a difference in the next cup.")
    return out


def general_text() -> Column:
    return F.lit("[DEMO] Open questions need a generator; the demo answers taste problems only.")


def adjustable_text(machine: Column) -> Column:
    from millrace.operators.diagnose import adjustable

    return F.array_join(adjustable(machine), ", ")


def judge_prompt(texts: Column) -> Column:
    return F.concat(F.lit("Rate from 1 to 5 as JSON with specificity, accuracy, clarity, actionability:\n"), F.substring(texts, 1, 3000))


def envelope(status: Column, text: Column, question: Column | None = None, iterations: Column | None = None) -> Column:
    return F.struct(status.alias("status"), text.alias("coaching_text"), (question if question is not None else F.lit("")).alias("clarification_question"), F.substring(F.uuid(), 1, 8).alias("session_id"), (iterations if iterations is not None else F.lit(1)).alias("iterations"))


# ------------------------------------------------------------------ tools and the agent loop

Tool = Callable[[DataFrame], DataFrame]


@dataclass
class Agent:
    """Many sessions at once through named tools, each a DataFrame -> DataFrame over the sessions it is called for.

    choose(state) gives each open session's next tool in column next_tool: a tool's name, `ask` (it
    halts with a question) or `stop`. At most `most` rounds; calls are logged in the state's array `calls`.
    Each round's state is stored by `keep`, so that no tool runs twice for a later reader.
    """

    tools: dict[str, Tool]
    choose: Callable[[DataFrame], Column]
    keep: Callable[[DataFrame], DataFrame]
    most: int = 8
    rounds: int = field(default=0, init=False)

    def run(self, sessions: DataFrame) -> DataFrame:
        state = sessions.withColumns({"calls": F.array().cast("array<string>"), "status": F.lit("open"), "iterations": F.lit(0)})
        for n in range(self.most):
            self.rounds = n + 1
            state = self.keep(state.withColumn("next_tool", F.when(F.col("status") == "open", self.choose(state)).otherwise("stop")))
            names = [r["next_tool"] for r in state.where("status = 'open'").select("next_tool").distinct().collect()]  # at most as many as there are tools
            if not names:
                break
            done = state.where("status <> 'open'")
            for name in sorted(names):
                rows = state.where((F.col("status") == "open") & (F.col("next_tool") == name))
                if name in self.tools:
                    rows = self.tools[name](rows).withColumn("calls", F.concat("calls", F.array(F.lit(name))))
                else:
                    rows = rows.withColumn("status", F.lit("clarification_needed" if name == "ask" else "done"))
                done = done.unionByName(rows.withColumn("iterations", F.lit(n + 1)), allowMissingColumns=True)
            state = done
        return self.keep(state.withColumn("status", F.when(F.col("status") == "open", "exhausted").otherwise(F.col("status"))).drop("next_tool"))
