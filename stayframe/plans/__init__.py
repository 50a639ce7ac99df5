"""Cleaning sequences and log folds put together from the operators."""
