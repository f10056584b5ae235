"""graphmill: code-graph and task-ledger analytics as plain Spark DataFrame plans."""
