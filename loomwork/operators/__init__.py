"""DataFrame operators: joins, roll-ups, ordered work, table changes, checks, graph walks."""
