"""DataFrame operators: joins, aggregations, windows (J*, A*, W*, O*, X*)."""
