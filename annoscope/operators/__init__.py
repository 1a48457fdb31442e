"""DataFrame -> DataFrame operators, grouped by concern (see each module's docstring)."""
