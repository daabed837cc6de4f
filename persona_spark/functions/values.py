"""Fixed values the results depend on."""

# Words and labels.
DEFAULT_PROMPT_TITLE = "Memory"
UNTITLED_LABEL = "Untitled Page"
PAGE_LABEL_PREFIX = "Page "
DEFAULT_PERSONA_NAME = "the user"
PERSONA_FIELDS = ("name", "age", "gender", "country", "location", "hobbies", "favorites", "bio")
UNKNOWN = "Unknown"
CUSTOM_MODEL = "Custom model"
FULL_TUNING_LABEL = "Full Fine-tune"
SAVE_ADAPTER = "lora"
SAVE_MERGED = "merged_16bit"
OUTPUT_ROOT = "./outputs/"

# Numbers.
SHORT_DATE = "MMM dd, yyyy"
LONG_DATE = "MMMM dd, yyyy"
ID_TAIL = 8
ENTRIES_PER_RESPONSE = 100
MAX_SEQ_LENGTH = 2048
LOG_TAIL_LINES = 10_000
SCHEDULE_SEED = 3407
ADAPTER_SCHEDULE = {"batch_size": 2, "accumulation": 4, "max_steps": 60}
FULL_SCHEDULE = {"batch_size": 1, "accumulation": 8, "max_steps": 60}
MIN_TEMPERATURE = 0.1
SAMPLING_FALLBACK = {"temperature": 1.0, "top_p": 0.95, "top_k": 64, "repetition_penalty": 1.0}
NAME_MIN_CHARS = 2
NAME_MAX_CHARS = 100
AGE_MIN = 0
AGE_MAX = 150
FILE_NAME_MAX_CHARS = 200

# Patterns.
MODEL_NAME_PART = r"[a-zA-Z0-9][-a-zA-Z0-9_.]*"
RESERVED_FILE_CHARACTERS = r'[<>:"/\\|?*]'

# Markers of the chat dialects.
TURN_USER = "<start_of_turn>user\n"
TURN_MODEL = "<start_of_turn>model\n"
TURN_MODEL_OPEN = "<start_of_turn>model"
TURN_END = "<end_of_turn>"
PIPE_ASSISTANT = "<|assistant|>"
PIPE_END = "<|end|>"
PIPE_EOT = "<|eot_id|>"
PLAIN_ASSISTANT = "Assistant:"
HEADER_ASSISTANT = "<|start_header_id|>assistant<|end_header_id|>"
BOS = "<bos>"

# The models on offer (id, name, description, accelerator memory, parameters).
MODEL_COLUMNS = ("id", "name", "description", "vram", "params")
MODELS = (
    ("unsloth/gemma-3-270m-it", "Gemma-3 270M", "Fast & efficient, great for beginners", "~4GB", "270M"),
    ("unsloth/gemma-2-2b-it", "Gemma-2 2B", "Balanced performance and quality", "~6GB", "2B"),
    ("unsloth/Llama-3.2-1B-Instruct", "Llama-3.2 1B", "Compact and fast", "~4GB", "1B"),
    ("unsloth/Llama-3.2-3B-Instruct", "Llama-3.2 3B", "Better quality responses", "~8GB", "3B"),
    ("unsloth/Meta-Llama-3.1-8B-Instruct", "Llama-3.1 8B", "High quality conversations", "~16GB", "8B"),
    ("unsloth/Qwen2.5-7B-Instruct", "Qwen-2.5 7B", "Excellent reasoning capabilities", "~14GB", "7B"),
    ("unsloth/Phi-3.5-mini-instruct", "Phi-3.5 Mini", "Microsoft's compact model", "~8GB", "3.8B"),
    ("unsloth/mistral-7b-instruct-v0.3", "Mistral 7B v0.3", "Strong general purpose model", "~14GB", "7B"),
    ("unsloth/Ministral-8B-Instruct-2410", "Ministral 8B", "Latest Ministral release", "~16GB", "8B"),
    ("unsloth/Llama-3.3-70B-Instruct", "Llama-3.3 70B", "Best quality (requires large GPU)", "~40GB", "70B"),
)

# Rules for settings typed in by hand (section, key, kind, default, minimum).
SETTING_RULE_COLUMNS = ("section", "key", "kind", "default_value", "minimum")
SETTING_RULES = (
    ("training", "batch_size", "int", "2", 1.0),
    ("training", "gradient_accumulation_steps", "int", "4", 1.0),
    ("training", "learning_rate", "float", "0.0002", None),
    ("training", "num_epochs", "int", "1", 1.0),
    ("training", "max_steps", "int", "60", 1.0),
    ("training", "warmup_steps", "int", "5", 0.0),
    ("training", "optimizer", "text", "adamw_8bit", None),
    ("training", "lr_scheduler_type", "text", "linear", None),
    ("lora", "r", "int", "16", 1.0),
    ("lora", "lora_alpha", "int", "16", 1.0),
    ("lora", "lora_dropout", "float", "0.0", None),
    ("model", "max_seq_length", "int", "2048", 128.0),
    ("model", "load_in_4bit", "bool", "false", None),
    ("unsloth", "dataset_num_proc", "int", "1", 1.0),
    ("unsloth", "packing", "bool", "false", None),
    ("unsloth", "use_gradient_checkpointing", "bool", "false", None),
    ("unsloth", "use_rslora", "bool", "false", None),
    ("unsloth", "use_loftq", "bool", "false", None),
    ("system", "debug_logs", "bool", "false", None),
    ("system", "num_gpus", "int", "1", 1.0),
    ("system", "gpu_ids", "stripped", "0", None),
    ("model", "max_new_tokens", "int", "256", 32.0),
    ("model", "temperature", "float", "0.7", None),
    ("model", "top_p", "float", "0.9", None),
    ("model", "top_k", "int", "50", 0.0),
    ("model", "repetition_penalty", "float", "1.1", None),
    ("model", "use_cache", "bool", "false", None),
    ("prompts", "system_prompt", "text", "", None),
    ("prompts", "response_structure", "text", "", None),
    ("huggingface", "private", "bool", "false", None),
)

# What adapter runs take over from the section of the speed-up library, and its stand-ins.
SPEEDUP_SECTION = "unsloth"
ADAPTER_SECTION = "lora"
TRAINING_SECTION = "training"
ADAPTER_TAKES = (
    ("use_gradient_checkpointing", "unsloth"),
    ("use_rslora", "false"),
    ("use_loftq", "false"),
)

# Settings every run starts from (section, key, value).
SETTING_COLUMNS = ("section", "key", "value")
DEFAULT_SETTINGS = (
    ("model", "default_model", "unsloth/gemma-3-270m-it"),
    ("model", "max_seq_length", "2048"),
    ("model", "load_in_4bit", "true"),
    ("model", "load_in_8bit", "false"),
    ("model", "max_new_tokens", "256"),
    ("model", "temperature", "0.7"),
    ("model", "top_p", "0.9"),
    ("model", "top_k", "50"),
    ("model", "repetition_penalty", "1.1"),
    ("model", "use_cache", "true"),
    ("training", "batch_size", "2"),
    ("training", "gradient_accumulation_steps", "4"),
    ("training", "learning_rate", "0.0002"),
    ("training", "num_epochs", "1"),
    ("training", "max_steps", "60"),
    ("training", "warmup_steps", "5"),
    ("training", "logging_steps", "1"),
    ("training", "optimizer", "adamw_8bit"),
    ("training", "weight_decay", "0.01"),
    ("training", "lr_scheduler_type", "linear"),
    ("lora", "r", "16"),
    ("lora", "lora_alpha", "16"),
    ("lora", "lora_dropout", "0.0"),
    ("lora", "bias", "none"),
    ("lora", "use_gradient_checkpointing", "unsloth"),
    ("lora", "use_rslora", "false"),
    ("lora", "use_loftq", "false"),
    ("lora", "target_modules", '["q_proj","k_proj","v_proj","o_proj","gate_proj","up_proj","down_proj"]'),
    ("inference", "max_new_tokens", "128"),
    ("inference", "temperature", "0.7"),
    ("inference", "top_p", "0.9"),
    ("inference", "use_cache", "true"),
    ("system", "debug_logs", "false"),
    ("system", "num_gpus", "1"),
    ("system", "gpu_ids", "0"),
    ("unsloth", "dataset_num_proc", "1"),
    ("unsloth", "packing", "false"),
    ("unsloth", "use_gradient_checkpointing", "true"),
    ("unsloth", "use_rslora", "false"),
    ("unsloth", "use_loftq", "false"),
)
