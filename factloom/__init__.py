"""Provable-fact graph analytics on Spark: extract facts, merge them into a bitemporal graph, derive more, ask."""

from factloom.operators.assist import TOOLS, assist, run_tool
from factloom.operators.merge import Graph, consolidated
from factloom.operators.query import explain_entity, query_facts
from factloom.operators.store import Store
from factloom.plans.pipeline import build
from factloom.schemas import CANDIDATES, ENTITIES, FACTS, PROVENANCE

__version__ = "0.1.0"
__all__ = ["CANDIDATES", "ENTITIES", "FACTS", "PROVENANCE", "TOOLS", "Graph", "Store", "__version__", "assist", "build", "consolidated", "explain_entity", "query_facts", "run_tool"]
