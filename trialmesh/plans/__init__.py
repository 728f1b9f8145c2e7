"""Named queries over the input tables, each with the SQL it is checked against."""


def all_plans():
    """Import every plan module and return the registry."""
    from trialmesh.plans import registry
    from trialmesh.plans import chunk_plans, model_plans, profile_plans, ranking_plans, registry_plans, retrieval_plans, scalar_plans, stream_plans, tabular_plans  # noqa: F401
    return registry
