"""A model stand-in whose answers follow from the request.

It lets the data jobs run and be checked without a model. Its scores say
nothing about the quality of any text.
"""

from __future__ import annotations

import json
import re

from parlance.functions.prompts import DEFAULT, Params

LETTERS = "etaoinshrdlucmfw"
YES = 7
VOCABULARY = 8


def _content(messages: list[dict], role: str) -> str:
    return next((m["content"] for m in messages if m["role"] == role), "")


def _listed(items: list[str]) -> str:
    return "Here you are: " + json.dumps(items, ensure_ascii=False)


def _head(template: str) -> str:
    return template[: template.index("{")]


def _slot(template: str, text: str) -> str:
    """What stands in a template's only slot; empty where the text is of another kind."""
    before, after = re.split(r"\{[a-z]+\}", template)
    return text[len(before) : len(text) - len(after)] if text.startswith(before) and text.endswith(after) else ""


class ScriptedClient:
    # Clients of one identity answer alike, as far as stored answers go.
    identity = "scripted"

    def generate(self, batch: list[list[dict]], params: Params) -> list[str]:
        return [self.reply(_content(m, "system"), _content(m, "user")) for m in batch]

    def reply(self, system: str, user: str) -> str:
        rest = _slot(DEFAULT.subject, user)
        if rest and system.startswith(DEFAULT.sub_topics[:30]):
            return _listed([f"price trends of {rest}", f"trends of price at {rest}", f"delivery delays at {rest}"])
        if rest:
            return _listed([
                "A buyer new to the trade", "A buyer new to this trade",
                f"The clerk counting {len(rest)} crates at night", "Someone else entirely",
            ])
        topic = _slot(DEFAULT.talk_about, user)
        if topic:
            second = re.search("Second person: (.*)", system)
            return (
                f"<cot>{topic}</cot>\n<dialogue>#A#: I think about {topic}.\n"
                f"#B#: So does {second.group(1) if second else ''}.</dialogue>"
            )
        if user.startswith(_head(DEFAULT.to_summarize)):
            return f"A talk of {len(_slot(DEFAULT.to_summarize, user))} characters"
        if user.startswith(_head(DEFAULT.to_assess)):
            return f"Fine.\nScore: {len(user) % 12}"
        if user.startswith(_head(DEFAULT.to_ask_about)):
            return _listed([w for w in _slot(DEFAULT.to_ask_about, user).split(" ") if w][:3])
        head, middle, _ = re.split(r"\{[a-z]+\}", DEFAULT.to_answer_from)
        if user.startswith(head):
            passage, _, questions = user.removeprefix(head).rpartition(middle)
            return _listed([f"{q} {passage.count(q)}" for q in json.loads(questions)])
        return user.split("\n")[-1]

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(t.count(c)) for c in LETTERS] for t in texts]

    def token_vectors(self, texts: list[str]) -> list[list[list[float]]]:
        return [[[float(len(w)), 1.0] for w in t.split(" ")] for t in texts]

    def loss(self, texts: list[str]) -> list[float]:
        return [len(t) / 100 for t in texts]

    def tokenize(self, batch: list[list[dict]]) -> list[list[int]]:
        return [[len(w) % YES for w in _content(m, "system").split(" ")] + [YES, 0] for m in batch]

    def yes_id(self) -> int:
        return YES

    def logits_at(self, tokens: list[list[int]], positions: list[int]) -> list[list[float]]:
        return [[(p * (v + 1) % 11) / 10 for v in range(VOCABULARY)] for p in positions]

    def rating_logits(self, batch: list[list[dict]]) -> list[list[float]]:
        sizes = [len(_content(m, "user")) for m in batch]
        return [[n % 3 / 2, n % 5 / 2, n % 7 / 2] for n in sizes]


class FirstWord(ScriptedClient):
    """Answers with the number of characters asked about and a fixed mark."""

    mark = "first"

    def reply(self, system: str, user: str) -> str:
        return f"{self.mark} {len(user)}"


class SecondRun(FirstWord):
    mark = "second"


class EchoFirst(ScriptedClient):
    """Predicts the first line of its input."""

    identity = "first line"

    def reply(self, system: str, user: str) -> str:
        return user.split("\n")[0]


class EchoAll(ScriptedClient):
    """Predicts its whole input."""

    identity = "whole input"

    def reply(self, system: str, user: str) -> str:
        return user
