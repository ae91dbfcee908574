"""DataFrame -> DataFrame operators, used with df.transform."""
