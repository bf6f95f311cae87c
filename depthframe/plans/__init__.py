"""The registered queries and the tables that they derive."""
