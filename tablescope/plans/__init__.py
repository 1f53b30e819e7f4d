"""Judgements and bundles built on the operators: rules over the profile tables."""
