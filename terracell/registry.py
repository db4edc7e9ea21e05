"""The register of tools: every operator by its name, toolbox and parameters."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Tool:
    name: str
    toolbox: str
    run: Callable
    summary: str

    @property
    def parameters(self) -> dict[str, object]:
        """Parameter names and defaults; inspect.Parameter.empty where one is required."""
        return {k: p.default for k, p in inspect.signature(self.run).parameters.items()}


TOOLS: dict[str, Tool] = {}


def tool(name: str, toolbox: str) -> Callable[[Callable], Callable]:
    """Registers an operator: a function from DataFrames and parameters to a DataFrame."""

    def put(run: Callable) -> Callable:
        register(name, toolbox, run)
        return run

    return put


def register(name: str, toolbox: str, run: Callable, summary: str | None = None) -> None:
    text = summary or (inspect.getdoc(run) or "").split("\n")[0]
    TOOLS[name] = Tool(name, toolbox, run, text)


def list_tools(keyword: str = "") -> list[str]:
    """Names of the tools whose name or summary has the keyword."""
    k = keyword.lower()
    return sorted(n for n, t in TOOLS.items() if k in n.lower() or k in t.summary.lower())


def run_tool(name: str, *args, **parameters):
    """Calls a tool by name; names are matched without case, blanks and underscores."""
    wanted = name.replace("_", "").replace(" ", "").lower()
    for n, t in TOOLS.items():
        if n.lower() == wanted:
            return t.run(*args, **parameters)
    raise KeyError(f"no tool is called {name}")


def describe(spark):
    """name, toolbox, summary and parameters of all tools as a DataFrame."""
    rows = [(t.name, t.toolbox, t.summary, ", ".join(t.parameters)) for t in TOOLS.values()]
    return spark.createDataFrame(sorted(rows), "name string, toolbox string, summary string, parameters string")
