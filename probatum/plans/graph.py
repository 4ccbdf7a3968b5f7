"""Reference graph of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.graph import build_edges, extract_references, resolve_references
from ..session import materialise


def reference_graph(chunks: DataFrame, norms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """References, their targets and the edges. The texts are read once: the references are written down first."""
    refs = materialise(extract_references(chunks), "references")
    resolved = resolve_references(refs, norms)
    return refs, resolved, build_edges(refs, resolved)
