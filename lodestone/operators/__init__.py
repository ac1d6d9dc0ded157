"""Dataset operators: chunking, retrieval, index upkeep, evaluation, prompts and chat logs."""
