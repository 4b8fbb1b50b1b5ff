def plan(df) -> str:
    """Physical plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()
