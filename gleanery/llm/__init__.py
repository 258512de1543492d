"""Training-data operators: each module holds one of them, ``queries`` registers them."""
