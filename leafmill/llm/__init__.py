"""Operators for training-data text: one module per problem, registered in ``registry``."""
