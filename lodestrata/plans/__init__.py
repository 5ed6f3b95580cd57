"""Query catalogue and the engine facade."""
