"""DataFrame operators; each takes and returns DataFrames (or a small
fitted model), never rows on the driver."""
