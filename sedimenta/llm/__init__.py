"""Training-data operators: ten distributed corpus components and their queries."""
