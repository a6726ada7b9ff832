"""Texts, patterns and numbers that results depend on."""

NOISE_LABEL = "__NOISE__"
NOISE_DESCRIPTION = "Text samples that do not belong to any of the defined categories"
DEFAULT_DESCRIPTION = "Text samples that belong to the '{label}' category"

# Characters that Python's str.strip removes.
SPACES = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
# Unicode words of two or more characters.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# The English stop words of MLlib's remover.
ENGLISH_STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it
its itself they them their theirs themselves what which who whom this that these those am is are was were be been
being have has had having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over under again further
then once here there when where why how all any both each few more most other some such no nor not only own same so
than too very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't
hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's
ought that's there's what's when's where's who's why's would
""".split())

CLEAR_CONFIDENCE = 0.8
AMBIGUOUS_CONFIDENCE = 0.3
FAILED_CONFIDENCE = 0.0
UNREADABLE_REPLY = "indeterminate"

PROXY_TOP = 0.9
PROXY_REST = 0.1

SMOTE_NEIGHBOURS = 5
SMOTE_MIN_ROWS = 20

FALLBACK_CLASSES = 50
EXPERIMENT_SIZES = (30, 50, 100)

MAX_PROMPT_TEXT = 500
TRUNCATION_SUFFIX = "..."

VALIDATOR_SYSTEM = (
    "You are a precise and accurate text classification validator.\n"
    "Your job is to determine if a text sample truly belongs to a specific class label.\n"
    "Be thorough in your analysis but respond with only 'True' or 'False'."
)

DESCRIBER_SYSTEM = (
    "You are an expert at understanding text classification categories.\n"
    "Given a class label name and examples of texts that belong to that category, provide a clear, "
    "concise description of what kind of text samples would belong to this category.\n"
    "Focus on the semantic meaning, content themes, topics, or characteristics that are common across "
    "the provided examples.\n"
    "Keep descriptions to 2-3 sentences. Base your description on the actual examples provided - do not "
    "make assumptions beyond what you see in the examples."
)

BINARY_TEMPLATE = """\
Task: Determine if the following text sample truly belongs to the predicted class label.

Class Information:
- Label: {label}
- Description: {description}

{examples_section}

Text to Validate: "{text}"

Analysis Instructions:
1. Read the text carefully and understand its main content/theme
2. Compare it against the class description and characteristics
3. Consider how well it fits compared to the provided examples
4. Make a binary decision about classification correctness. The text is not related to the class if it is not related to the class description or examples.
5. If there is no clear evidence that the text is related to the class, respond with 'False'.

Question: Does this text truly belong to the "{label}" class?

Respond with ONLY "True" or "False".
"""

MULTICLASS_TEMPLATE = """\
Task: Validate a multi-class text classification result.

Available Classes:
{class_descriptions}

Text Sample: "{text}"
Predicted Class: {predicted_class}

{examples_section}

Analysis Instructions:
1. Evaluate if the predicted class is the BEST fit among all available classes
2. Consider whether another class might be more appropriate
3. Focus on the most distinctive characteristics of each class

Question: Is "{predicted_class}" the correct class for this text among the available options?

Respond with ONLY "True" or "False".
"""

REASONING_TEMPLATE = """\
Task: Validate text classification and provide reasoning.

Class Information:
- Label: {label}
- Description: {description}

{examples_section}

Text to Validate: "{text}"

Please analyze this classification step by step:

1. CONTENT ANALYSIS: What is the main content/theme of this text?

2. CLASS ALIGNMENT: How well does this content align with the class description?

3. EXAMPLE COMPARISON: How similar is this text to the provided examples?

4. DECISION: Does this text belong to the "{label}" class?

Format your response as:
Content: [your analysis]
Alignment: [your assessment]
Comparison: [your comparison]
Decision: True/False
Confidence: [High/Medium/Low]
"""

UNCERTAINTY_TEMPLATE = """\
Text Sample: "{text}"
Predicted Class: {predicted_class}
Classification Confidence: {confidence}

Available Classes: {available_classes}

Task: Assess the uncertainty level of this classification.

Consider:
- Clarity of the text content
- Distinctiveness of class indicators
- Potential ambiguity or overlap with other classes
- Overall confidence in the classification

Uncertainty Levels:
- CERTAIN: Text clearly belongs to the predicted class
- LIKELY: Text probably belongs to the predicted class
- UNCERTAIN: Classification is ambiguous or unclear
- UNLIKELY: Text probably doesn't belong to the predicted class

Respond with ONLY one of: CERTAIN, LIKELY, UNCERTAIN, UNLIKELY
"""

DESCRIBE_TEMPLATE = """\
Class Label: "{label}"

Based on the following examples of texts that belong to this category, provide a clear description of what kind of text samples would belong to this category.

Examples from this category:
{examples}

Focus on the common themes, topics, content patterns, and characteristics that you observe across these examples. Do not make assumptions beyond what you see in these examples."""

# Worked question and answer pairs shown to the judge before the real question.
FEW_SHOT_PAIRS = (
    (
        'Class: "product_review"\n'
        'Description: "Customer reviews and opinions about products or services"\n'
        'Text: "This smartphone has amazing battery life and great camera quality!"\n'
        'Does this text belong to the "product_review" class?\n',
        "True",
    ),
    (
        'Class: "news_article" \n'
        'Description: "News reports and journalistic content about current events"\n'
        'Text: "Scientists discover new species of deep-sea fish in Pacific Ocean"\n'
        'Does this text belong to the "news_article" class?\n',
        "True",
    ),
    (
        'Class: "technical_documentation"\n'
        'Description: "Technical guides, manuals, and instructional content"\n'
        'Text: "What\'s your favorite movie genre and why do you like it?"\n'
        'Does this text belong to the "technical_documentation" class?\n',
        "False",
    ),
)

ACKNOWLEDGEMENT = "Understood. I'll follow these instructions."

# Where each provider puts the reply text.
REPLY_PATHS = (
    "$.candidates[0].content.parts[0].text",
    "$.content[0].text",
    "$.choices[0].message.content",
    "$.text",
)
