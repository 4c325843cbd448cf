"""Private tabular analytics as Spark jobs: dense counts, noisy releases, decoding, scoring."""

from importlib import import_module

#: Public names and their modules. They are imported when first asked for: tasks that need one module load no other.
_PLACES = {
    "Schema": "functions.bins", "load_schema": "sources.schemas", "read_table": "sources.tables",
    "Ledger": "operators.ledger", "derive": "operators.configure", "release": "operators.stage", "Release": "operators.stage",
    "fit_release": "operators.fitted", "draw": "operators.decode", "decode": "operators.decode", "select_to_release": "operators.select",
    "spanning_tree": "operators.adaptive", "worst_tables": "operators.adaptive",
    "cohort_quotas": "streaming.generation", "cell_quotas": "streaming.generation", "exact_mock": "streaming.generation", "generate": "streaming.generation",
    "correct": "operators.assess", "bound_with_controls": "operators.assess", "evaluate": "operators.assess",
    "attacked": "operators.attacks", "controlled": "operators.attacks",
}
__all__ = list(_PLACES)


def __getattr__(name: str):
    if name not in _PLACES:
        raise AttributeError(f"hushtable has no {name}")
    return getattr(import_module(f"hushtable.{_PLACES[name]}"), name)
