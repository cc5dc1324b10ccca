"""Generic DataFrame operators. They take column names; the plans bind them to tables."""
