"""packetlens """
