"""Domain queries composed from the operators, over the star schema."""
