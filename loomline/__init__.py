"""Context and retrieval analytics as lazy DataFrame plans, with training-data operators beside them."""
